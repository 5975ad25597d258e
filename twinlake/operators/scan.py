"""Ordered per-key scans ("last non-null value so far", running sums) that survive hot keys.

A plain ``Window.partitionBy(key)`` puts every row of a key in one task; one entity
holding a third of the log would then be one task.  ``ordered_scan`` instead:

1. counts the rows by hash of the key and cuts the keys that hold too many into
   contiguous ranges of ``(key, order...)`` ("segments"; the bounds are taken from a
   sample of those rows and pinned).  All other keys are one segment;
2. scans each ``(key, segment)`` locally with a window (bounded by the segment):
   one shuffle of the rows, and all there is if no key was cut;
3. else summarises each ``(key, segment)`` of the cut keys (last non-null value,
   total) — a partial aggregate — and scans the *summaries* per key, which is at
   most one row per segment, to get each segment's carry-in;
4. joins the carry-in back on ``(key, segment)``; only the small summary side moves.

Later scans over the same rows reuse segments and partitioning (no new shuffle).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEG = "_seg"
CUT = "cut"     # metadata of the segment column: whether any key has several segments
SAMPLED = 100   # sampled rows of which one bounds a segment
PARTITION_BYTES = 8 << 20  # Parquet bytes whose rows a task sorts or groups by key
SEGMENT_BYTES = 128 << 20  # input bytes a segment is sized for


def input_bytes(df: DataFrame) -> int:
    """Bytes of the plan's inputs as the planner knows them (file sizes); inputs of unknown size count 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def segment_count(df: DataFrame, size: int | None = None) -> int:
    """Segments for ``df``: one per ``size`` (``SEGMENT_BYTES``) of input bytes, at least the shuffle partition count."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // (size or SEGMENT_BYTES)))


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: a lineage one step deep, columns read as needed."""
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, f"scan-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame, *keep: DataFrame | None) -> None:
    """Delete the ``pinned`` tables that a plan reads and nothing will read again, but not those that one of ``keep`` reads."""
    from ..session import scratch_path
    from ..sources.tables import _fs
    own = scratch_path(df.sparkSession, "scan-")
    folders = [{f.rsplit("/", 1)[0] for f in d.inputFiles()} for d in (df, *keep) if d is not None]
    for path in folders[0].difference(*folders[1:]):
        if own.rsplit(":", 1)[-1] in path:
            fs, p = _fs(df.sparkSession, path)
            fs.delete(p, True)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by its keys in a partition for each ``PARTITION_BYTES`` of input, where those are more than the session's."""
    n = segment_count(df, PARTITION_BYTES)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def segment(df: DataFrame, key: list[str], order: list[str], n: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """Attach a segment id: 0, and up from 0 in the order of (key, order) where keys with one hash hold more than a half of
    an ``n``-th of the rows.  ``like``: a cheaper plan with the keys (and order) of ``df``'s rows, to count them by."""
    if SEG in df.columns:
        return df
    n, like = n or segment_count(df), df if like is None else like
    bucket = F.pmod(F.xxhash64(*key), F.lit(max(1024, 16 * n)))
    counts = {r["b"]: r["n"] for r in like.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 16 numbers a segment
    share = max(1.0, sum(counts.values()) / (2 * n))
    hot = {b: -(-c // share) for b, c in counts.items() if c > share}
    if not hot:
        return df.select("*", F.pmod(F.xxhash64(*key), F.lit(1)).cast("int").alias(SEG, metadata={CUT: False}))
    pos, parts = F.struct(*key, *order), sum(hot.values())
    rows = like.filter(bucket.isin(*hot)).select(bucket.alias("_hot"), pos.alias("_pos"))
    some = rows.sample(min(1.0, SAMPLED * parts / sum(counts[b] for b in hot)), seed=7).groupBy("_hot").agg(F.sort_array(F.collect_list("_pos")).alias("_all"))
    size = F.create_map(*[F.lit(x) for b, c in hot.items() for x in (b, int(c))])[F.col("_hot")]
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.col("_all")[F.floor(i * F.size("_all") / size).cast("int")])
    bounds = some.select("_hot", cuts.alias("_cuts")).checkpoint(eager=True)  # two positions a segment at most
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(int(max(hot.values())).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= F.size("_cuts")) & (F.get("_cuts", lo + s - 1) < pos), lo + s).otherwise(lo))
    out = df.withColumn("_hot", bucket).join(F.broadcast(bounds), "_hot", "left")
    return pinned(out.select(*df.columns, F.when(F.col("_cuts").isNotNull(), below).otherwise(0).alias(SEG)))


def ordered_scan(df: DataFrame, key: list[str], order: list[str],
                 lasts: dict[str, Column] | None = None,
                 sums: dict[str, Column] | None = None,
                 inclusive: bool = False, segments: int | None = None,
                 skew_safe: bool = True, like: DataFrame | None = None) -> DataFrame:
    """Add, per row, for each ``lasts`` item the last non-null value of the
    expression among earlier rows of the same key (``inclusive``: up to and
    including this row), and for each ``sums`` item the running sum.

    ``order`` must be a total order within a key (add a unique tie-breaker).
    ``like``: a cheaper plan with the same keys and order columns, to find hot keys by.
    """
    lasts, sums = lasts or {}, sums or {}
    end = Window.currentRow if inclusive else -1
    base = df.select("*", *[e.alias(f"_lv_{n}") for n, e in lasts.items()],
                     *[e.alias(f"_sv_{n}") for n, e in sums.items()])
    if not skew_safe:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        out = base.select("*", *[F.last(f"_lv_{n}", ignorenulls=True).over(w).alias(n) for n in lasts],
                          *[F.coalesce(F.sum(f"_sv_{n}").over(w), F.lit(0)).alias(n) for n in sums])
        return out.drop(*[f"_lv_{n}" for n in lasts], *[f"_sv_{n}" for n in sums])

    seg = segment(base, key, order, segments, like)
    part = [*key, SEG]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = seg.select("*", *[F.last(f"_lv_{n}", ignorenulls=True).over(w).alias(f"_ll_{n}") for n in lasts],
                       *[F.sum(f"_sv_{n}").over(w).alias(f"_ls_{n}") for n in sums])
    if not seg.schema[SEG].metadata.get(CUT, True):
        return local.select(*[c for c in df.columns if c != SEG], SEG, *[F.col(f"_ll_{n}").alias(n) for n in lasts],
                            *[F.coalesce(F.col(f"_ls_{n}"), F.lit(0)).alias(n) for n in sums])
    pos = F.struct(*[F.col(c) for c in order])
    summ = seg.groupBy(*part).agg(
        *[F.max_by(f"_lv_{n}", F.when(F.col(f"_lv_{n}").isNotNull(), pos)).alias(f"_tl_{n}") for n in lasts],
        *[F.sum(f"_sv_{n}").alias(f"_ts_{n}") for n in sums],
        F.lit(1).alias("_one"))
    ws = Window.partitionBy(*key).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*part, *[F.last(f"_tl_{n}", ignorenulls=True).over(ws).alias(f"_cl_{n}") for n in lasts],
                        *[F.sum(f"_ts_{n}").over(ws).alias(f"_cs_{n}") for n in sums])
    carry = carry.filter(F.col(SEG) > 0).toDF(*[f"_k_{c}" for c in part], *carry.columns[len(part):])
    j = local.join(carry, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part]), "left")
    out = j.select(*[c for c in df.columns if c != SEG], SEG,
                   *[F.coalesce(F.col(f"_ll_{n}"), F.col(f"_cl_{n}")).alias(n) for n in lasts],
                   *[(F.coalesce(F.col(f"_ls_{n}"), F.lit(0)) + F.coalesce(F.col(f"_cs_{n}"), F.lit(0))).alias(n)
                     for n in sums])
    return out
