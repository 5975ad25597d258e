"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

The corpus is a schedule of unit slots.  Weights are integers ``a``, ``cycle`` is
their sum, so a source's target is exactly a / cycle and it is a periodic task: its
block k is released at floor(k * cycle / a) and due at ceil((k + 1) * cycle / a).
Earliest deadline first, among released blocks, puts each block between the two, so
after any number of slots each source has had its target's share within less than
one block, with no drift from one cycle to the next.  The schedule repeats after
``cycle`` slots: one cycle is computed (a row a slot) and each block finds its slot
by division.

Weights
* ``targets``: taken as exact decimals and brought to the smallest whole numbers, so
  0.9995 and 0.0005 are 1,999 and 1 of a cycle of 2,000.
* without: the whole number nearest to a source's row count to the power ``alpha``.
* Where they add up to more than ``max_cycle`` they are rounded to that total, at
  least 1 each: a target then differs from the real weight by half of 1 / max_cycle.
  A cycle has at most ``max_cycle`` slots and one more for each source.

The order within a source is by md5 of the id.  Ranks come from counts of hash
ranges, so a source with most of the rows is still ranked by many tasks; a range that
one id overfills is split by row position.

Results in special cases
* Every row is scheduled, whatever its size; when a source runs out, its later
  slots stay empty and the others keep their order.
* Null source: a source of its own.  Null id: hashed as the empty text.
  Repeated rows: one slot place each.  Empty table: empty result.
* A source of weight 0, or not in ``targets``: no slot of the cycle (quota 0, null
  release and deadline).  Its blocks follow after all others, source by source.
* Any number of sources; a negative or infinite target is a ValueError.
* ``docs`` is evaluated more than once.  If its rows may come in another order each
  time (after a shuffle) and ids repeat, say ``stable=False``: it is checkpointed.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import documents, let, pin

#: Slots of one cycle, beyond which weights are rounded.
MAX_CYCLE = 20_000
#: Documents of a source that are scheduled together.
BLOCK_DOCS = 8
#: Without targets, a source's weight is its count of rows to this power.
ALPHA = 0.5
#: Rows that a rank window should hold at most, on average; one of four times as many is split.
RANK_ROWS = 20_000
#: Tables by source and slot are broadcast up to this many rows, and joined by their keys beyond.
BROADCAST_ROWS = 200_000

OWN = ("mix_quota", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")
_SOURCES = 1 << 24  # a pending block is one long: its deadline, then its source's place


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def whole_weights(targets: dict) -> dict:
    """The targets as the smallest whole numbers in the same proportion."""
    if any(not math.isfinite(w) or w < 0 for w in targets.values()):
        raise ValueError("a target weight is a finite number, 0 or more")
    exact = {source: Fraction(str(w)) for source, w in targets.items()}
    scale = math.lcm(1, *[f.denominator for f in exact.values()])
    whole = {source: int(f * scale) for source, f in exact.items()}
    common = math.gcd(*whole.values()) or 1
    return {source: w // common for source, w in whole.items()}


def weights(counts: DataFrame, alpha: float, targets: dict | None, max_cycle: int) -> DataFrame:
    """(_key, _n, _quota): each source's whole-number weight, 0 for those without one."""
    n = F.col("_n").cast("double")
    if targets is None:
        raw = counts.withColumn("_raw", F.round(F.sqrt(n) if alpha == 0.5 else F.pow(n, F.lit(float(alpha)))))
    else:
        named = [("null" if s is None else f"={s}", float(w)) for s, w in whole_weights(targets).items()]
        given = counts.sparkSession.createDataFrame(named, "_key string, _raw double")
        raw = counts.join(given, "_key", "left")
    total = F.sum("_raw").over(Window.partitionBy())  # one row for each source
    quota = F.when(F.col("_raw") > 0, F.when(total > max_cycle, F.greatest(F.lit(1.0), F.round(F.col("_raw") * max_cycle / total))).otherwise(F.col("_raw")))
    return raw.select("_key", "_n", F.coalesce(quota, F.lit(0.0)).cast("long").alias("_quota"))


def one_cycle(quota: DataFrame, cycle: int) -> DataFrame:
    """Earliest deadline first over one cycle: (_key, _j, _slot), the slot of the j-th block of each source."""
    tasks = quota.filter("_quota > 0").select("_key", "_quota", (F.row_number().over(Window.orderBy("_key")) - 1).cast("long").alias("_i"))
    j, a = F.col("_j"), F.col("_quota")
    blocks = tasks.select("_i", "_quota", F.explode(F.sequence(F.lit(0).cast("long"), a - 1)).alias("_j")).select(
        F.floor(j * cycle / a).cast("long").alias("_t"), (F.floor(((j + 1) * cycle + a - 1) / a).cast("long") * _SOURCES + F.col("_i")).alias("_code"))
    released = (quota.sparkSession.range(cycle).select(F.col("id").alias("_t")).join(blocks.groupBy("_t").agg(F.collect_list("_code").alias("_codes")), "_t", "left")
                .select("_t", F.coalesce("_codes", F.array().cast("array<bigint>")).alias("_codes")))
    one = released.agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_codes"))), lambda x: x["_codes"]).alias("_released"))

    def step(state: Column, codes: Column) -> Column:
        def serve(pending: Column) -> Column:
            return let(F.array_min(pending), lambda first: F.struct(
                F.array_remove(pending, first).alias("pending"), F.concat(state["slots"], F.array(first)).alias("slots")))
        return let(F.concat(state["pending"], codes), serve)

    none = F.array().cast("array<bigint>")
    slots = F.aggregate("_released", F.struct(none.alias("pending"), none.alias("slots")), step, lambda s: s["slots"])
    served = one.select(F.posexplode(slots).alias("_slot", "_code")).select(F.col("_slot").cast("long").alias("_slot"), F.pmod("_code", F.lit(_SOURCES)).alias("_i"))
    served = served.withColumn("_j", (F.row_number().over(Window.partitionBy("_i").orderBy("_slot")) - 1).cast("long"))
    return served.join(tasks, "_i").select("_key", "_j", "_slot")


def _ranked(keyed: DataFrame, n_rows: int) -> DataFrame:
    """(_row, _key, _rank): each row's place in its source, by hash and id, from 0."""
    n_ranges = max(256, -(-n_rows // RANK_ROWS))
    keyed = keyed.withColumn("_range", F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * n_ranges / F.lit(1 << 32)).cast("long"))
    sizes = keyed.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > 4 * RANK_ROWS).select("_key", "_range", F.ceil(F.col("_n") / RANK_ROWS).alias("_splits"))
    if hot.isEmpty():
        keyed, sizes = keyed.withColumn("_split", F.lit(0).cast("long")), sizes.withColumn("_split", F.lit(0).cast("long"))
    else:  # a range holds that many rows by repeated ids; at most a row of `hot` for each 4 * RANK_ROWS rows
        hot = F.broadcast(hot) if n_rows // (4 * RANK_ROWS) <= BROADCAST_ROWS else hot
        keyed = keyed.withColumn("_pos", F.monotonically_increasing_id()).join(hot, ["_key", "_range"], "left")
        keyed = keyed.withColumn("_split", F.coalesce(F.pmod(F.xxhash64("_pos"), F.col("_splits")), F.lit(0).cast("long"))).drop("_pos", "_splits")
        sizes = keyed.groupBy("_key", "_range", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_range", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_key", "_range", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_key", "_range", "_split").orderBy("_hash", F.col("_row.id"))
    return (keyed.withColumn("_in", F.row_number().over(within)).join(starts, ["_key", "_range", "_split"])
            .select("_row", "_key", (F.col("_before") + F.col("_in") - 1).alias("_rank")))


def schedule(docs: DataFrame, targets: dict | None = None, alpha: float = ALPHA, max_cycle: int = MAX_CYCLE,
             block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", source_col: str = "source",
             carry: list[str] | None = None, stable: bool = True) -> DataFrame:
    """The place of every row: its source's quota, block, release, deadline and slot, and its place in the block.

    ``carry``: names of columns of ``docs`` that the result has besides id and source; the schedule's own
    columns take the place of columns with their names.
    """
    carry = [c for c in (carry or []) if c not in (id_col, source_col, *OWN)]
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("_row"),
                        _key(F.col(source_col)).alias("_key"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_hash"))
    if not stable:
        keyed = pin(keyed)
    quota = weights(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), alpha, targets, max_cycle)
    whole = F.ceil(F.ceil(F.col("_n") / block_docs) / F.nullif(F.col("_quota"), F.lit(0)))  # cycles that a source lasts
    sums = quota.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_quota"), F.lit(0)).alias("cycle"),
                     F.coalesce(F.max(whole), F.lit(0)).alias("cycles")).first()
    cycle, hint = sums["cycle"], F.broadcast if sums["sources"] + sums["cycle"] <= BROADCAST_ROWS else lambda df: df

    idle = F.when(F.col("_quota") == 0, F.ceil(F.col("_n") / block_docs)).otherwise(0)  # blocks after the last cycle
    earlier = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.select("_key", "_quota", (F.coalesce(F.sum(idle).over(earlier), F.lit(0)) + cycle * sums["cycles"]).cast("long").alias("_tail"))
    blocks = _ranked(keyed, sums["rows"]).join(hint(quota), "_key").withColumn("_block", F.floor(F.col("_rank") / block_docs).cast("long"))
    a, k = F.nullif(F.col("_quota"), F.lit(0)), F.col("_block")  # null: no slot of the cycle
    blocks = blocks.withColumn("_j", F.pmod(k, a))
    placed = blocks.join(hint(one_cycle(quota, cycle)), ["_key", "_j"], "left")
    return placed.select(
        F.col("_row.id").alias(id_col), F.col("_row.source").alias(source_col), *[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("_quota").cast("int").alias("mix_quota"), k.alias("mix_block"), F.floor(k * cycle / a).cast("long").alias("mix_release"),
        F.floor(((k + 1) * cycle + a - 1) / a).cast("long").alias("mix_deadline"),
        F.coalesce(F.floor(k / a).cast("long") * cycle + F.col("_slot"), F.col("_tail") + k).alias("mix_slot"),
        F.pmod("_rank", F.lit(block_docs)).cast("int").alias("mix_place"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """All rows of ``docs``, its columns only, sorted into the schedule's order."""
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    whole = docs.select(F.col(id_col), F.col(source_col), F.struct(*docs.columns).alias("_twinlake_row"))
    out = schedule(whole, carry=["_twinlake_row"], **options)
    return out.orderBy("mix_slot", "mix_place").select("_twinlake_row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    return schedule(documents(spark, sf_dir)).select(
        "doc_id", "source", F.col("mix_quota").alias("quota"), F.col("mix_block").alias("block"), F.col("mix_release").alias("release"),
        F.col("mix_deadline").alias("deadline"), F.col("mix_slot").alias("slot"), F.col("mix_place").alias("place"))


ORACLE = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
counts AS (SELECT k, round(sqrt(CAST(count(*) AS DOUBLE))) AS raw FROM keyed GROUP BY k),
quota AS (SELECT k, CAST(CASE WHEN sum(raw) OVER () > {MAX_CYCLE} THEN greatest(1.0, round(raw * {MAX_CYCLE} / sum(raw) OVER ())) ELSE raw END AS BIGINT) AS a FROM counts),
one AS (SELECT list(a ORDER BY k) AS qa, list(k ORDER BY k) AS qk, CAST(sum(a) AS BIGINT) AS w FROM quota),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(qa, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS i FROM one
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, p: CASE WHEN p = c THEN x + 1 ELSE x END), c FROM (
    SELECT t, done, list_min(list_transform(done, lambda x, p:
        CASE WHEN (x * w) // qa[p] <= t + 1 THEN (((x + 1) * w + qa[p] - 1) // qa[p]) * 100000 + p END)) % 100000 AS c
    FROM edf, one WHERE t < w - 1)),
pattern AS (SELECT qk[i] AS k, t AS s, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS j FROM edf, one WHERE t >= 0),
blocks AS (
  SELECT doc_id, source, k, r // {BLOCK_DOCS} AS b, r % {BLOCK_DOCS} AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY h, doc_id) - 1 AS r FROM keyed))
SELECT doc_id, source, CAST(a AS INTEGER) AS quota, b AS block, (b * w) // a AS release, ((b + 1) * w + a - 1) // a AS deadline,
  (b // a) * w + s AS slot, CAST(place AS INTEGER) AS place
FROM blocks JOIN quota USING (k) JOIN pattern ON pattern.k = blocks.k AND pattern.j = blocks.b % a, one
"""
