"""Command folding: create / update / delete / get messages judged in order per key.

Bulk re-aim of the reference's one-message handlers.  A command log
``(event_id, ts, <key>, op, has_<field>..., <field>...)`` is folded in
``(ts, event_id)`` order per key:

* liveness before a command = type of the last create/delete *attempted* earlier
  for the key (an attempted create leaves the row live whether accepted or not;
  an attempted delete leaves it absent);
* codes: create on a live key 400, any other op on an absent key 404, else 200;
* state after a command: per field, the latest accepted write that carried the
  field; an accepted create sets every field (absent ones to NULL), a partial
  update only the fields present in its payload, and ``updated_at`` moves only
  when at least one field was present.

Times come from the message timestamp, never the wall clock (F15), so a replay
gives the same rows.  Both passes are ``ordered_scan``s, so one hot entity is
spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import SEG, ordered_scan

CREATE, UPDATE, DELETE, GET = "create", "update", "delete", "get"
WRITE_OPS = (CREATE, UPDATE, DELETE)


def fold(cmd: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "event_id"),
         fields: tuple[str, ...] = ("value", "props"), skew_safe: bool = True,
         segments: int | None = None) -> DataFrame:
    """Judge every command and attach the entity state after it.

    Adds: ``live_before, code, accepted, live_after, <field>..., created_at, updated_at``.
    State columns are NULL where the entity does not exist after the command,
    except for an accepted delete, which carries the deleted row.
    """
    op = F.col("op")
    cd = F.when(op.isin(CREATE, DELETE), op)
    s1 = ordered_scan(cmd, [key], list(order), lasts={"_prev_cd": cd}, inclusive=False, skew_safe=skew_safe,
                      segments=segments)
    live_before = F.coalesce(F.col("_prev_cd"), F.lit(DELETE)) == CREATE
    code = (F.when(op == CREATE, F.when(live_before, 400).otherwise(200))
            .otherwise(F.when(live_before, 200).otherwise(404)))
    s1 = s1.withColumn("live_before", live_before).withColumn("code", code) \
           .withColumn("accepted", (F.col("code") == 200) & op.isin(*WRITE_OPS)).drop("_prev_cd")

    acc = F.col("accepted")
    any_field = reduce(lambda a, b: a | b, [F.col(f"has_{f}") for f in fields])
    lasts = {}
    for f in fields:
        lasts[f"_st_{f}"] = (F.when(acc & (op == CREATE),
                                    F.struct(F.when(F.col(f"has_{f}"), F.col(f)).alias("v")))
                             .when(acc & (op == UPDATE) & F.col(f"has_{f}"), F.struct(F.col(f).alias("v"))))
    lasts["_st_created_at"] = F.when(acc & (op == CREATE), F.col(order[0]))
    lasts["_st_updated_at"] = F.when(acc & ((op == CREATE) | ((op == UPDATE) & any_field)), F.col(order[0]))
    s2 = ordered_scan(s1, [key], list(order), lasts=lasts, inclusive=True, skew_safe=skew_safe)

    live_after = (F.when(op == CREATE, F.lit(True)).when(op == DELETE, F.lit(False))
                  .otherwise(F.col("live_before")))
    show = live_after | (acc & (op == DELETE))
    state = [F.when(show, F.col(f"_st_{f}.v")).alias(f) for f in fields] + [
        F.when(show, F.col("_st_created_at")).alias("created_at"),
        F.when(show, F.col("_st_updated_at")).alias("updated_at")]
    keep = [c for c in cmd.columns if c not in fields and c != SEG]
    return s2.select(*keep, *[F.col(f).alias(f"payload_{f}") for f in fields],
                     "live_before", "code", "accepted", live_after.alias("live_after"), *state)


def status(folded: DataFrame, key: str = "id") -> DataFrame:
    """K4/K6: one row per command with its reply code."""
    return folded.select("event_id", key, "op", "code")


def accepted_rows(folded: DataFrame, op: str, key: str = "id",
                  fields: tuple[str, ...] = ("value", "props")) -> DataFrame:
    """K1/K3/K5: the entity row returned by each accepted command of one type
    (create: the new row; update: the row after; delete: the deleted row)."""
    return folded.filter(F.col("accepted") & (F.col("op") == op)).select(
        "event_id", key, *fields, "created_at", "updated_at")


def current_state(folded: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "event_id"),
                  fields: tuple[str, ...] = ("value", "props")) -> DataFrame:
    """Live rows after the whole log.  The last command per key is picked
    with ``max_by`` (a partial aggregate, so a hot key combines map-side)."""
    st = F.struct(F.col("live_after").alias("live"), *[F.col(f) for f in fields], "created_at", "updated_at")
    last = folded.groupBy(key).agg(F.max_by(st, F.struct(*[F.col(c) for c in order])).alias("_s"))
    return last.filter("_s.live").select(key, *[F.col(f"_s.{f}").alias(f) for f in fields],
                                         F.col("_s.created_at").alias("created_at"),
                                         F.col("_s.updated_at").alias("updated_at"))


EVENT_NAMES = {CREATE: "created", UPDATE: "updated", DELETE: "deleted"}


def domain_events(folded: DataFrame, entity: str = "author", key: str = "id",
                  fields: tuple[str, ...] = ("value", "props")) -> DataFrame:
    """One event per accepted write.  Created/updated events carry the row
    after the write; deleted events carry the id only."""
    op = F.col("op")
    etype = F.concat(F.lit(entity + "."), F.coalesce(*[F.when(op == k, F.lit(v)) for k, v in EVENT_NAMES.items()]))
    is_del = op == DELETE
    return folded.filter("accepted").select(
        "event_id", etype.alias("event_type"), key,
        *[F.when(~is_del, F.col(f)).alias(f) for f in fields],
        F.when(~is_del, F.col("updated_at")).alias("updated_at"),
        F.col("ts").alias("occurred_at"))


def dedupe_events(events: DataFrame, keys: tuple[str, ...] = ("event_id", "event_type")) -> DataFrame:
    """The reference applies each created event twice (factory and handler);
    one copy per event identity is kept."""
    return events.dropDuplicates(list(keys))


# Entity (table, snake_case) <-> aggregate (camelCase) column names.
AUTHOR_COLUMNS = {"id": "id", "first_name": "firstName", "last_name": "lastName", "birth_date": "birthDate",
                  "created_at": "createdAt", "updated_at": "updatedAt"}
BOOK_COLUMNS = {"id": "id", "title": "title", "isbn": "isbn", "published_year": "publishedYear",
                "created_at": "createdAt", "updated_at": "updatedAt"}
LINK_COLUMNS = {"id": "id", "author_id": "authorId", "book_id": "bookId", "assigned_at": "assignedAt"}


def to_aggregate(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Entity rows -> aggregate field names (columns not in the mapping kept)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns and k != v})


def to_entity(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Aggregate field names -> entity column names."""
    back = {v: k for k, v in mapping.items()}
    return df.withColumnsRenamed({k: v for k, v in back.items() if k in df.columns and k != v})


TOPICS = {CREATE: "create", UPDATE: "update", DELETE: "delete", GET: "get"}
# Fields each topic's command carries (K15: extra payload fields are dropped).
TOPIC_FIELDS = {CREATE: ("value", "props"), UPDATE: ("id", "value", "props"), DELETE: ("id",), GET: ("id",)}


def route(cmd: DataFrame, entity: str = "author", key: str = "id",
          fields: tuple[str, ...] = ("value", "props")) -> DataFrame:
    """Topic per message and the typed command projection of its payload."""
    op = F.col("op")
    topic = F.concat(F.lit(entity + "."), op)
    cols = []
    for c in (key, *fields):
        allowed = [o for o, fs in TOPIC_FIELDS.items() if c in fs]
        present = op.isin(*allowed)
        if c in fields:
            present = present & F.col(f"has_{c}")
        cols.append(F.when(present, F.col(c)).alias(c))
    return cmd.select("event_id", topic.alias("topic"), *cols)


# The fields each topic's command takes from its payload.
COMMAND_FIELDS = {
    "author.create": ("firstName", "lastName", "birthDate"),
    "author.update": ("id", "firstName", "lastName", "birthDate"),
    "author.delete": ("id",), "author.get": ("id",),
    "author.getAll": ("page", "limit", "firstName", "lastName", "birthDate"),
    "book.create": ("title", "isbn", "publishedYear"),
    "book.update": ("id", "title", "isbn", "publishedYear"),
    "book.delete": ("id",), "book.get": ("id",),
    "book.getAll": ("page", "limit", "title", "isbn", "publishedYear"),
    "authorBook.assign": ("authorId", "bookId"), "authorBook.unassign": ("id",),
}


def route_messages(msgs: DataFrame, keep: tuple[str, ...] = ("event_id",), topic: str = "topic",
                   payload: str = "payload") -> DataFrame:
    """T2/K15 over raw messages: one column per field, as text, filled only where the topic's command takes the
    field; other payload fields are dropped, messages of unknown topics too."""
    fields = dict.fromkeys(f for fs in COMMAND_FIELDS.values() for f in fs)
    cols = [F.when(F.col(topic).isin(*[k for k, fs in COMMAND_FIELDS.items() if f in fs]),
                   F.get_json_object(payload, f"$.{f}")).alias(f) for f in fields]
    return msgs.filter(F.col(topic).isin(*COMMAND_FIELDS)).select(*keep, topic, *cols)


# --- assignments (K8-K10) ----------------------------------------------------
# The reply texts of the assignment handlers.
MSG_AUTHOR_NOT_FOUND = "Author with ID {} not found."
MSG_BOOK_NOT_FOUND = "Book with ID {} not found."
MSG_ALREADY_ASSIGNED = "Author {} is already assigned to Book {}."
MSG_ASSIGNMENT_NOT_FOUND = "Assignment with ID {} not found."
MSG_ISBN_EXISTS = "Book with ISBN {} already exists"


def _fmt(template: str, *cols) -> Column:
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for c, p in zip(cols, parts[1:]):
        out += [c.cast("string"), F.lit(p)]
    return F.concat(*out)


def assign(cmds: DataFrame, authors: DataFrame, books: DataFrame, order: list[str],
           author_col: str = "author_id", book_col: str = "book_id",
           author_key: str = "id", book_key: str = "id", existing_links: DataFrame | None = None) -> DataFrame:
    """K8/K9 (J11 duplicate-pair check): author must exist (404), then book (404),
    then the pair must not be assigned yet (409), neither by an earlier request nor in
    ``existing_links`` (the stored pairs); the first valid request for a pair wins.

    Parent existence is a left join to *distinct* parent keys; "first" is a
    ``min`` over the order per pair (partial aggregate, no per-pair window), so a
    pair requested by a third of all messages is still combined map-side.
    """
    from .relations import flag_parents
    f = flag_parents(cmds, [(authors, author_key, author_col, "_author_ok"),
                            (books, book_key, book_col, "_book_ok")])
    pos = F.struct(*[F.col(c) for c in order])
    # parent existence is a property of the pair, shared by all its requests, so the
    # first request per pair comes straight from the raw requests: the aggregate
    # does not wait for (or recompute) the existence joins
    first = cmds.groupBy(author_col, book_col).agg(F.min(pos).alias("_first"))
    j = f.join(first, [author_col, book_col], "left")
    a, b = F.col(author_col), F.col(book_col)
    fresh = pos == F.col("_first")
    if existing_links is not None:
        stored = existing_links.select(author_col, book_col).distinct().withColumn("_stored", F.lit(True))
        j = j.join(stored, [author_col, book_col], "left")
        fresh = fresh & F.col("_stored").isNull()
    code = (F.when(~F.col("_author_ok"), 404).when(~F.col("_book_ok"), 404)
            .when(fresh, 200).otherwise(409))
    msg = (F.when(~F.col("_author_ok"), _fmt(MSG_AUTHOR_NOT_FOUND, a))
           .when(~F.col("_book_ok"), _fmt(MSG_BOOK_NOT_FOUND, b))
           .when(fresh, F.lit(None).cast("string"))
           .otherwise(_fmt(MSG_ALREADY_ASSIGNED, a, b)))
    keep = [c for c in cmds.columns]
    return j.select(*keep, code.alias("code"), msg.alias("message"))


def link_id(a: Column, b: Column) -> Column:
    """Surrogate id of an assignment, stable across retries."""
    from ..functions.scalar import stable_uuid
    return stable_uuid(a, b)


def unassign(requests: DataFrame, links: DataFrame, order: list[str], id_col: str = "link_id") -> DataFrame:
    """Delete a link by id; a missing id is 404; the first request for an
    existing link deletes it (200, returning the deleted row), later ones find
    nothing (404)."""
    pos = F.struct(*[F.col(c) for c in order])
    l = links.withColumn("_exists", F.lit(True))
    j = requests.join(l, id_col, "left")
    # existence is a property of the link id, shared by all requests for it, so the
    # first request per id is aggregated from the requests alone
    first = requests.groupBy(id_col).agg(F.min(pos).alias("_first"))
    k = j.join(first, id_col, "left")
    ok = F.col("_exists") & (pos == F.col("_first"))
    cols = [c for c in links.columns if c != id_col]
    return k.select(*requests.columns, F.when(ok, 200).otherwise(404).alias("code"),
                    *[F.when(ok, F.col(c)).alias(c) for c in cols],
                    F.when(ok, F.lit(None).cast("string"))
                     .otherwise(_fmt(MSG_ASSIGNMENT_NOT_FOUND, F.col(id_col))).alias("message"))


def assignment_log(cmds: DataFrame, authors: DataFrame, books: DataFrame, order: list[str],
                   author_col: str = "author_id", book_col: str = "book_id", author_key: str = "id",
                   book_key: str = "id", existing_links: DataFrame | None = None, segments: int | None = None) -> DataFrame:
    """K8-K10 in one order: ``op`` is ``assign`` or ``unassign``; a pair may be assigned again after it was unassigned.

    Before a request its pair is assigned if the last earlier request that could take effect was an ``assign`` with both
    parents, or, with none earlier, if the pair is in ``existing_links``.  Assign: 404 (author, then book), 409, else 200.
    Unassign of a pair not assigned: 404.  The scan is segmented, so a pair with a third of all requests is no hot task.
    """
    from .relations import flag_parents
    a, b, op = F.col(author_col), F.col(book_col), F.col("op")
    f = flag_parents(cmds, [(authors, author_key, author_col, "_author_ok"), (books, book_key, book_col, "_book_ok")])
    effect = F.when((op == "unassign") | (F.col("_author_ok") & F.col("_book_ok")), op)
    s = ordered_scan(f, [author_col, book_col], order, lasts={"_prev": effect}, segments=segments, like=cmds)
    stored = F.lit(False)
    if existing_links is not None:
        s = s.join(existing_links.select(author_col, book_col).distinct().withColumn("_stored", F.lit(True)),
                   [author_col, book_col], "left")
        stored = F.col("_stored").isNotNull()
    live = F.when(F.col("_prev").isNull(), stored).otherwise(F.col("_prev") == "assign")
    s = s.withColumn("_live", live)
    lacking = [(~F.col("_author_ok"), 404, _fmt(MSG_AUTHOR_NOT_FOUND, a)), (~F.col("_book_ok"), 404, _fmt(MSG_BOOK_NOT_FOUND, b)),
               (F.col("_live"), 409, _fmt(MSG_ALREADY_ASSIGNED, a, b))]
    code = F.when(op == "unassign", F.when(F.col("_live"), 200).otherwise(404))
    msg = F.when(op == "unassign", F.when(~F.col("_live"), _fmt(MSG_ASSIGNMENT_NOT_FOUND, link_id(a, b))))
    for cond, status_, text in lacking:
        code, msg = code.when(cond, status_), msg.when(cond, text)
    return s.select(*cmds.columns, code.otherwise(200).cast("int").alias("code"), msg.alias("message"))


def assignment_events(judged: DataFrame, author_col: str = "author_id", book_col: str = "book_id",
                      at: str = "ts", keep: tuple[str, ...] = ()) -> DataFrame:
    """One event per accepted assign (the whole link) or unassign (its id only)."""
    made = F.col("op") == "assign"
    return judged.filter(F.col("code") == 200).select(
        *keep, F.when(made, "authorBook.created").otherwise("authorBook.deleted").alias("event_type"),
        link_id(F.col(author_col), F.col(book_col)).alias("link_id"),
        *[F.when(made, F.col(c)).alias(n) for c, n in ((author_col, "author_id"), (book_col, "book_id"), (at, "assigned_at"))])


def create_unique(cmds: DataFrame, unique: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """K2: a create whose unique value (non-null) was taken by an earlier
    create, or is held by a row of the stored table ``existing``, is rejected with 400."""
    pos = F.struct(*[F.col(c) for c in order])
    first = cmds.filter(F.col(unique).isNotNull()).groupBy(unique).agg(F.min(pos).alias("_first"))
    j = cmds.join(first, unique, "left")
    bad = F.col(unique).isNotNull() & (pos != F.col("_first"))
    if existing is not None:
        held = existing.select(unique).filter(F.col(unique).isNotNull()).distinct().withColumn("_held", F.lit(True))
        j = j.join(held, unique, "left")
        bad = bad | F.col("_held").isNotNull()
    return j.select(*cmds.columns, F.when(bad, 400).otherwise(200).alias("code"),
                    F.when(bad, _fmt(MSG_ISBN_EXISTS, F.col(unique))).alias("message"))


# --- replies (E1, E9, E10 applied to the fold) ------------------------------
MSG_ENTITY_NOT_FOUND = "{} with ID {} not found."
MSG_ENTITY_EXISTS = "{} with ID {} already exists."


def replies(folded: DataFrame, entity: str = "author", label: str = "Author", key: str = "id",
            fields: tuple[str, ...] = ("value", "props")) -> DataFrame:
    """One reply per command: success with the entity row as JSON, or the error
    code and message; the envelope timestamp is the message time (not wall clock)."""
    from ..functions import envelope as E
    from ..functions.scalar import iso_timestamp
    ok = F.col("code") == 200
    data = F.to_json(F.struct(F.col(key).alias("id"), *[F.col(f).alias(f) for f in fields],
                              iso_timestamp(F.col("created_at")).alias("createdAt"),
                              iso_timestamp(F.col("updated_at")).alias("updatedAt")),
                     E.JSON_OPTS)
    nf, ex = MSG_ENTITY_NOT_FOUND.split("{}"), MSG_ENTITY_EXISTS.split("{}")
    msg = (F.when(F.col("code") == 404, F.concat(F.lit(label + nf[1]), F.col(key).cast("string"), F.lit(nf[2])))
           .when(F.col("code") == 400, F.concat(F.lit(label + ex[1]), F.col(key).cast("string"), F.lit(ex[2]))))
    env = F.when(ok, E.success(data, F.col("ts"))).otherwise(E.error(msg, F.col("code"), F.col("ts")))
    return folded.select("event_id", F.concat(F.lit(entity + "."), F.col("op")).alias("topic"), env.alias("r")).select(
        "event_id", "topic", F.col("r.success").alias("success"), F.col("r.data").alias("data_json"),
        F.col("r.error.code").alias("error_code"), F.col("r.error.message").alias("error_message"),
        F.col("r.meta.timestamp").alias("timestamp"))
