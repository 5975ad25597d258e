"""Assignments judged against the parents as they were at the time of the request.

Three logs are merged: lives of authors, lives of books, and link requests.  A request sees the state that
everything earlier left:

* a parent is live if the last earlier create or delete of it was a create (stored parents are live from the start);
* deleting a parent deletes its links at that moment (the cascade), so a parent created again has none;
* a pair is assigned if the last earlier request that took effect was an assign, later than the last delete of
  either parent.

Each parent side is one segmented scan over the union of its life log and the requests, keyed by the parent's id, and
the pair side one over the requests alone (``ordered_scan``), so a parent or pair with a third of all rows is no hot
task.  No state table is joined row by row and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .commands import CREATE, DELETE, MSG_ALREADY_ASSIGNED, MSG_ASSIGNMENT_NOT_FOUND, MSG_AUTHOR_NOT_FOUND, MSG_BOOK_NOT_FOUND, _fmt, link_id
from .scan import SEG, ordered_scan, segment_count


def _position(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def parent_asof(rows: DataFrame, lives: DataFrame, ref: str, order: list[str], live: str, gone: str,
                stored: DataFrame | None = None, segments: int | None = None,
                like: DataFrame | None = None) -> DataFrame:
    """Add to ``rows`` whether the parent in column ``ref`` is live just before them (``live``) and the position of its
    last earlier delete (``gone``).

    ``lives``: (``ref``, ``op`` create or delete, the columns of ``order``); ``stored``: ids that are live from the start, in a
    column named ``ref``.  Positions are total over both inputs together.  A null reference is not live.
    ``like``: a cheaper plan with the references and positions of ``rows``.
    """
    own = [c for c in rows.columns if c != SEG]
    both = rows.select(*own, F.lit(None).cast("string").alias("_life")).unionByName(
        lives.select(ref, *order, F.col("op").alias("_life")), allowMissingColumns=True)
    pos = _position(order)
    both_like = (rows if like is None else like).select(ref, *order).unionByName(lives.select(ref, *order))
    s = ordered_scan(both, [ref], order, lasts={"_cd": F.col("_life"), gone: F.when(F.col("_life") == DELETE, pos)}, segments=segments, like=both_like)
    s = s.filter(F.col("_life").isNull()).drop("_life", SEG)
    known = F.col("_cd") == CREATE
    if stored is None:
        flag = F.coalesce(known, F.lit(False))
    else:
        s = s.join(stored.select(ref).distinct().withColumn("_stored", F.lit(True)), ref, "left")
        flag = F.coalesce(known, F.col("_stored"), F.lit(False))
    return s.withColumn(live, flag & F.col(ref).isNotNull()).select(*own, live, gone)


def _stored_links(links: DataFrame, authors: DataFrame | None, books: DataFrame | None, author_col: str, book_col: str) -> DataFrame:
    """The stored pairs whose parents are stored, too."""
    out = links.select(author_col, book_col).distinct()
    for parents, c in ((authors, author_col), (books, book_col)):
        out = out.limit(0) if parents is None else out.join(parents.select(c).distinct(), c, "left_semi")
    return out.select(author_col, book_col)


def assignments_asof(requests: DataFrame, author_lives: DataFrame, book_lives: DataFrame, order: list[str],
                     author_col: str = "author_id", book_col: str = "book_id", authors: DataFrame | None = None,
                     books: DataFrame | None = None, links: DataFrame | None = None, segments: int | None = None) -> DataFrame:
    """Judge assign and unassign requests (``op``) in the order of ``order``, a total order over all three logs.

    ``authors``, ``books`` and ``links`` are what is stored before the logs begin.  Codes and messages are those of
    ``commands.assignment_log``; a stored link whose parent is not stored does not exist.
    Adds ``code``, ``message``, ``_author_gone``, ``_book_gone`` (positions of the last earlier deletes).
    """
    a, b, op = F.col(author_col), F.col(book_col), F.col("op")
    # sized by the logs themselves: sizes of checkpointed joins are the planner's products
    segments = segments or max(map(segment_count, (requests, author_lives, book_lives)))
    s = parent_asof(requests, author_lives, author_col, order, "_author_ok", "_author_gone", authors, segments)
    s = parent_asof(s, book_lives, book_col, order, "_book_ok", "_book_gone", books, segments, requests)
    effect = F.when((op == "unassign") | (F.col("_author_ok") & F.col("_book_ok")), F.struct(op.alias("op"), _position(order).alias("at")))
    s = ordered_scan(s, [author_col, book_col], order, lasts={"_prev": effect}, segments=segments, like=requests)
    untouched = F.col("_author_gone").isNull() & F.col("_book_gone").isNull()
    first = F.lit(False)
    if links is not None:
        stored = _stored_links(links, authors, books, author_col, book_col)
        s = s.join(stored.withColumn("_linked", F.lit(True)), [author_col, book_col], "left")
        first = F.col("_linked").isNotNull() & untouched
    at = F.col("_prev.at")
    kept = (F.col("_author_gone").isNull() | (F.col("_author_gone") < at)) & (F.col("_book_gone").isNull() | (F.col("_book_gone") < at))
    s = s.withColumn("_live", F.when(F.col("_prev").isNull(), first).otherwise((F.col("_prev.op") == "assign") & kept))
    code = (F.when(op == "unassign", F.when(F.col("_live"), 200).otherwise(404))
            .when(~F.col("_author_ok"), 404).when(~F.col("_book_ok"), 404).when(F.col("_live"), 409).otherwise(200))
    msg = (F.when(op == "unassign", F.when(~F.col("_live"), _fmt(MSG_ASSIGNMENT_NOT_FOUND, link_id(a, b))))
           .when(~F.col("_author_ok"), _fmt(MSG_AUTHOR_NOT_FOUND, a)).when(~F.col("_book_ok"), _fmt(MSG_BOOK_NOT_FOUND, b))
           .when(F.col("_live"), _fmt(MSG_ALREADY_ASSIGNED, a, b)))
    return s.select(*requests.columns, code.cast("int").alias("code"), msg.alias("message"), "_author_gone", "_book_gone")


def links_after(judged: DataFrame, author_lives: DataFrame, book_lives: DataFrame, order: list[str],
                author_col: str = "author_id", book_col: str = "book_id", links: DataFrame | None = None,
                authors: DataFrame | None = None, books: DataFrame | None = None) -> DataFrame:
    """The links that exist after all three logs, with the position at which each was made (null: stored).

    The last accepted request of a pair decides; a later delete of either parent takes the link away.  Partial
    aggregates per pair and per parent, no window."""
    pos, pair = _position(order), [author_col, book_col]
    last = (judged.filter(F.col("code") == 200).groupBy(*pair)
            .agg(F.max_by("op", pos).alias("op"), F.max(pos).alias("at")))
    if links is not None:
        stored = _stored_links(links, authors, books, author_col, book_col)
        last = last.join(stored, pair, "full_outer").select(*pair, F.coalesce("op", F.lit("assign")).alias("op"), "at")  # judged once
    out = last.filter(F.col("op") == "assign")
    for lives, c in ((author_lives, author_col), (book_lives, book_col)):
        gone = lives.filter(F.col("op") == DELETE).groupBy(c).agg(F.max(_position(order)).alias("_gone"))
        out = out.join(gone, c, "left").filter(F.col("_gone").isNull() | (F.col("_gone") < F.col("at"))).drop("_gone")
    return out.select(*pair, "at")
