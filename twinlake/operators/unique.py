"""A unique value over the whole life of its holders (K2).

Commands run in one global order.  A create is accepted if its id is not live and its value (if any) is free; an
update that sets a value is accepted if its id is live and the value is free or its own; a delete of a live id frees
what it held.  Whether a value is free depends on commands of other ids, and whether those were accepted on commands
of other values: a fold over two keys.

Ids that claim no value that somebody else claims or holds cannot be rejected; reads, updates that set no value and
commands that follow a delete without a create in between change nothing.  None of these take part.  The others are
judged by a fixpoint of two segmented scans that alternate until no verdict changes:

1. by id, with the rejections known so far: which commands find their id live, what the id held before;
2. by value, over the claims and releases that follow: a claim is rejected if the last earlier event of its value
   is another id's claim.

A command's verdict depends on earlier ones only, so the fixpoint is the sequential result.  Hot ids and hot values
are split by the scans.  Where values are scarce each verdict turns later ones, and the rounds would be as many as the
longest chain of them.  When the changes do not fall fast enough for ``ROUNDS_LEFT`` more rounds, the commands are folded
in order instead, each connected component of ids and values by itself (``_by_component``): every row once, whatever the
length of the chains, with what the component's ids hold as the only state.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import reduce
from math import log as ln

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commands import CREATE, DELETE, MSG_ENTITY_EXISTS, MSG_ENTITY_NOT_FOUND, MSG_ISBN_EXISTS, UPDATE, _fmt
from .scan import SEG, dropped, ordered_scan, pinned, segment_count

log = logging.getLogger(__name__)

#: Rounds that may be left, by the fall of the changes from one round to the next, for another round to be taken.
ROUNDS_LEFT = 3


def _alive(rows: DataFrame, order: list[str], stored: DataFrame | None, segments: int | None) -> DataFrame:
    """Scan by id: adds ``_live`` (the id is live before the command) and the columns of ``stored``."""
    op, free = F.col("op"), ~F.col("_rejected")
    s = ordered_scan(rows, ["_id"], order, lasts={"_cd": F.when(op.isin(CREATE, DELETE) & free, op)}, segments=segments)
    s = s.withColumn("_was", F.lit(False)) if stored is None else s.join(stored, "_id", "left")
    return s.withColumn("_live", F.coalesce(F.col("_cd") == CREATE, F.col("_was"), F.lit(False))).drop("_cd", "_was")


def _by_id(rows: DataFrame, order: list[str], stored: DataFrame | None, segments: int | None) -> DataFrame:
    """Scan by id: adds ``_live`` (the id is live before the command) and ``_held`` (the value it holds then)."""
    op, free = F.col("op"), ~F.col("_rejected")
    s = _alive(rows, order, stored, segments)
    if stored is None:
        s = s.withColumn("_was_value", F.lit(None).cast(rows.schema["_value"].dataType))
    # what the id holds: the value of its last accepted create, or accepted update that set one; nothing after a delete
    sets = F.when((op == CREATE) & free & ~F.col("_live"), F.struct(F.col("_value").alias("v")))
    sets = sets.when((op == UPDATE) & free & F.col("_live") & F.col("_sets"), F.struct(F.col("_value").alias("v")))
    sets = sets.when((op == DELETE) & F.col("_live"), F.struct(F.lit(None).cast(rows.schema["_value"].dataType).alias("v")))
    s = ordered_scan(s, ["_id"], order, lasts={"_last": sets}, segments=segments)
    return s.withColumn("_held", F.when(F.col("_last").isNotNull(), F.col("_last.v")).otherwise(F.col("_was_value"))).drop("_was_value", "_last", SEG)


def _by_value(rows: DataFrame, like: DataFrame, order: list[str], stored: DataFrame | None, segments: int | None) -> DataFrame:
    """Scan by value: each command once, with ``_now`` = its claim finds the value held by another id (``like``: the commands to
    find hot values by)."""
    op, v = F.col("op"), F.col("_value")
    tries = v.isNotNull() & (((op == CREATE) & ~F.col("_live")) | ((op == UPDATE) & F.col("_live") & F.col("_sets") & ~v.eqNullSafe(F.col("_held"))))
    done = ~F.col("_rejected")
    changes = (op == UPDATE) & F.col("_live") & F.col("_sets") & done & ~v.eqNullSafe(F.col("_held"))
    frees = F.col("_held").isNotNull() & (changes | ((op == DELETE) & F.col("_live")))
    events = F.array(F.struct(F.when(tries, v).alias("key"), F.lit(True).alias("own"), F.when(tries & done, F.lit("claim")).alias("event")),
                     F.struct(F.when(frees, F.col("_held")).alias("key"), F.lit(False).alias("own"), F.lit("free").alias("event")))
    events = F.filter(events, lambda e: e["own"] | e["key"].isNotNull())
    s = rows.withColumn("_tries", tries).withColumn("_e", F.explode(events)).select(
        *rows.columns, "_tries", F.col("_e.key").alias("_key"), F.col("_e.own").alias("_own"), F.col("_e.event").alias("_event"))
    holder = F.when(F.col("_event") == "claim", F.struct(F.lit(True).alias("held"), F.col("_id").alias("by")))
    holder = holder.when(F.col("_event") == "free", F.struct(F.lit(False).alias("held"), F.col("_id").alias("by")))
    # rows without an event have no key and need no order: they lie with their ids
    s = s.withColumn("_none", F.when(F.col("_key").isNull(), F.col("_id")))
    like = like.withColumn("_key", v).withColumn("_none", F.when(v.isNull(), F.col("_id")))
    s = ordered_scan(s, ["_key", "_none"], order, lasts={"_before": holder}, segments=segments, like=like).drop(SEG, "_none")
    s = s.filter("_own")
    held, by = F.col("_before.held"), F.col("_before.by")
    if stored is not None:
        s = s.join(stored.select(F.col("_was_value").alias("_key"), F.col("_id").alias("_first")).filter("_key IS NOT NULL"), "_key", "left")
        held = F.when(F.col("_before").isNull(), F.col("_first").isNotNull()).otherwise(F.col("_before.held"))
        by = F.when(F.col("_before").isNull(), F.col("_first")).otherwise(F.col("_before.by"))
    return s.withColumn("_now", F.coalesce(F.col("_tries") & held & (by != F.col("_id")), F.lit(False)))


def _listed(c: pa.Array) -> list:
    """``to_pylist`` by way of numpy, which is faster, where that keeps nulls and types."""
    return c.to_numpy(zero_copy_only=False).tolist() if not c.null_count or pa.types.is_string(c.type) else c.to_pylist()


def _folded(columns: list[str], key: str, value: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads commands in order, holders (without ``op``) before them, and gives the commands' ``columns`` and ``_rejected``.  The
    state is what live ids hold."""
    def run(batches):
        held, holder = {}, {}  # id -> value or None; value -> id
        for batch in batches:
            rejected = []
            for op, i, v, sets in zip(*(_listed(batch.column(c)) for c in ("op", key, value, "_sets")), strict=True):
                no = False
                if op == DELETE:
                    if (old := held.pop(i, None)) is not None:
                        holder.pop(old, None)
                elif op is None or (op == CREATE and i not in held) or (op == UPDATE and sets and i in held and held[i] != v):
                    no = op is not None and v is not None and v in holder
                    if not no:
                        if (old := held.get(i)) is not None:
                            holder.pop(old, None)
                        held[i] = v
                        if v is not None:
                            holder[v] = i
                rejected.append(no)
            out = pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | {"_rejected": pa.array(rejected, pa.bool_())})
            yield out.filter(batch.column("op").is_valid())
    return run


def _key(df: DataFrame, c: str) -> tuple[DataFrame, str]:
    """A column to look ``c`` up by in a worker: numbers and text as they are, others as JSON."""
    if isinstance(df.schema[c].dataType, T.IntegralType | T.StringType):
        return df, c
    return df.withColumn(f"{c}_key", F.when(F.col(c).isNotNull(), F.to_json(F.struct(c)))), f"{c}_key"


def _by_component(rows: DataFrame, order: list[str], stored: DataFrame | None, tasks: int) -> DataFrame:
    """``order``, ``op``, ``_id`` of ``rows`` with ``_rejected`` as one command after the other gives it.  Ids and values that no
    chain of claims links are judged apart; two components with one hash are only judged by one task."""
    from ..llm.graph import components
    s = rows.select(*order, "op", "_id", "_value", "_sets")
    if stored is not None:
        s = s.unionByName(stored.select("_id", F.col("_was_value").alias("_value")), allowMissingColumns=True)
    pairs = s.filter("(_sets OR op IS NULL) AND _value IS NOT NULL").select("_id", F.xxhash64("_value").alias("_v"))
    least = pinned(pairs.groupBy("_id").agg(F.min("_v").alias("_least")))  # one value of each id stands for the id
    found = components(pairs.join(least, "_id").select(F.col("_v").alias("a"), F.col("_least").alias("b")))
    of = least.join(found, F.col("_least") == F.col("node"), "left").select("_id", F.coalesce("component", "_least").alias("_comp"))
    (s, key), columns = _key(s, "_id"), [*order, "op", "_id"]
    s, value = _key(s, "_value")
    s = s.join(of, "_id", "left").repartition(tasks, "_comp").sortWithinPartitions(F.col("op").isNotNull(), *order)
    judged = pinned(s.mapInArrow(_folded(columns, key, value), rows.select(*columns, "_rejected").schema))
    dropped(least)
    return judged


def judge_unique(cmds: DataFrame, unique: str, order: list[str], key: str = "id", has: str | None = None, stored: DataFrame | None = None,
                 label: str = "Book", segments: int | None = None) -> tuple[DataFrame, int]:
    """Codes and messages of ``cmds`` (``op``, ``key``, ``unique``, the columns of ``order``), and the number of rounds.

    ``has``: column that says whether an update carries the value (all do without it); ``stored``: live rows (``key``,
    ``unique``) before the log, each value held once.  200 accepted, 404 id not live, 400 id live already or value taken.
    ``order`` must be total and ids not null.
    """
    segments = segments or segment_count(cmds)  # of the log itself: sizes of checkpointed joins are the planner's products
    sets = F.col(has) if has else F.lit(True)
    base = cmds.select(*order, "op", F.col(key).alias("_id"), F.when(sets, F.col(unique)).alias("_value"), sets.alias("_sets"))
    first = None if stored is None else stored.select(F.col(key).alias("_id"), F.lit(True).alias("_was"), F.col(unique).alias("_was_value"))

    claims = base.filter(F.col("op").isin(CREATE, UPDATE) & F.col("_value").isNotNull()).select("_id", "_value")
    if first is not None:
        claims = claims.unionByName(first.filter("_was_value IS NOT NULL").select("_id", F.col("_was_value").alias("_value")))
    contested = claims.groupBy("_value").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).filter("a <> b").select("_value")
    ids = pinned(claims.join(contested, "_value", "left_semi").select("_id").distinct())
    near = None if first is None else pinned(first.join(ids, "_id", "left_semi"))
    op, none = F.col("op"), F.lit(False)
    base = base.withColumn("_rejected", none)
    acts = F.coalesce(op.isin(CREATE, DELETE) | ((op == UPDATE) & F.col("_sets")), none)
    # an id is certainly not live after a delete, or at first, until the next create, accepted or not
    tried = _alive(base.filter(acts).join(ids, "_id", "left_semi"), order, near, segments)
    acting = pinned(tried.select(*base.columns, ((op == CREATE) | F.col("_live")).alias("_may")))
    dropped(tried, ids, near)
    rows = acting.filter("_may").select(*base.columns)
    rounds, before = 0, None
    while True:
        rounds += 1
        by_id = _by_id(rows, order, near, segments)
        plan = _by_value(by_id, rows, order, near, segments).select(*base.columns, "_now")
        judged = pinned(plan)
        for read in (by_id, plan):  # judged holds all rows of the round
            dropped(read, near, acting)
        changed = judged.filter(F.col("_now") != F.col("_rejected")).agg(F.count(F.lit(1)).alias("n")).first()["n"]  # one row
        log.info("unique values: round %d changed %d verdicts", rounds, changed)
        rows = judged.withColumn("_rejected", F.col("_now")).select(*base.columns)  # still read from the files of judged
        if not changed:
            break
        if before is not None and (changed >= before or ln(changed + 1) / ln(before / changed) > ROUNDS_LEFT):
            log.info("unique values: the commands are folded in order")
            dropped(judged)
            rows = _by_component(acting.filter("_may").select(*base.columns), order, near, segments)
            break
        before = changed
    still = base.join(ids.withColumn("_in", F.lit(True)), "_id", "left").filter(F.col("_in").isNull() | ~acts)
    every = reduce(DataFrame.unionByName, [d.select(*order, "op", "_id", "_rejected") for d in (rows, acting.filter("NOT _may"), still)])
    verdicts = _alive(every, order, first, segments).select(*order, "_live", "_rejected")
    live, k = F.col("_live"), F.col(key)
    code = F.when(op == CREATE, F.when(live | F.col("_rejected"), 400).otherwise(200)).when(~live, 404).when(F.col("_rejected"), 400).otherwise(200)
    exists, missing = MSG_ENTITY_EXISTS.replace("{}", label, 1), MSG_ENTITY_NOT_FOUND.replace("{}", label, 1)
    msg = (F.when((op == CREATE) & live, _fmt(exists, k)).when(F.col("_rejected"), _fmt(MSG_ISBN_EXISTS, F.col(unique)))
           .when((op != CREATE) & ~live, _fmt(missing, k)))
    out = cmds.join(verdicts, order, "inner").select(*cmds.columns, code.alias("code"), msg.alias("message"))
    return out, rounds
