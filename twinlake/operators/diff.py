"""Row, key-set, definition and snapshot diffs between a write and a read table.

The diff is computed once per table pair and every later step (upsert, delete,
report) derives from it or from a cheap key-only join, instead of re-scanning
per operation.  All comparisons are joins on key columns: nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normalise_definition
from .scan import spread

INSERT, UPDATE, DELETE, SAME = "insert", "update", "delete", "same"
CREATE, DROP, RECREATE = "create", "drop", "recreate"


def _all(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs) if cs else F.lit(True)


def row_diff(write: DataFrame, read: DataFrame, keys: list[str],
             compare: list[str] | None = None) -> DataFrame:
    """``keys + action`` for the union of both key sets.

    J7 keyed match: one full outer join on the key; non-key columns compared null-safe (``<=>``),
    so NULL = NULL is "same".  Exact: no hash stands in for the values.
    Precondition: the key is unique on both sides (``plans.sync.sync_table``
    checks it first), so the join never pairs up copies.
    """
    cols = compare if compare is not None else [c for c in write.columns if c not in keys]
    w = write.select(*keys, F.lit(True).alias("_w"), *[F.col(c).alias("_w_" + c) for c in cols])
    r = read.select(*keys, F.lit(True).alias("_r"), *[F.col(c).alias("_r_" + c) for c in cols])
    j = w.join(r, keys, "full_outer")
    same = _all([F.col("_w_" + c).eqNullSafe(F.col("_r_" + c)) for c in cols])
    action = (F.when(F.col("_r").isNull(), F.lit(INSERT))
              .when(F.col("_w").isNull(), F.lit(DELETE))
              .when(same, F.lit(SAME)).otherwise(F.lit(UPDATE)))
    return j.select(*keys, action.alias("action"))


def diff_counts(diff: DataFrame) -> DataFrame:
    """Rows per action."""
    return diff.groupBy("action").agg(F.count(F.lit(1)).alias("n_rows"))


def orphans(read: DataFrame, write: DataFrame, keys: list[str]) -> DataFrame:
    """Read rows whose key tuple is absent from write.  ``pk != ALL(keys)``
    (P8) becomes an anti join on all key columns; the key set is never collected."""
    return spread(read, keys).join(write.select(*keys), keys, "left_anti")


def definition_diff(write: DataFrame, read: DataFrame, key: str, text: str) -> DataFrame:
    """By name, create / drop / recreate (normalised text differs) / same."""
    w = write.select(key, normalise_definition(F.col(text)).alias("_wt"), F.lit(True).alias("_w"))
    r = read.select(key, normalise_definition(F.col(text)).alias("_rt"), F.lit(True).alias("_r"))
    j = w.join(r, key, "full_outer")
    action = (F.when(F.col("_r").isNull(), F.lit(CREATE))
              .when(F.col("_w").isNull(), F.lit(DROP))
              .when(F.col("_wt").eqNullSafe(F.col("_rt")), F.lit(SAME))
              .otherwise(F.lit(RECREATE)))
    return j.select(key, action.alias("action"))


def name_set_diff(write_names: DataFrame, read_names: DataFrame, name: str) -> DataFrame:
    """Names only in write -> create/add; only in read -> drop.
    One full outer join on the name (safe on catalogs built from literals)."""
    w = write_names.select(name).distinct().withColumn("_w", F.lit(True))
    r = read_names.select(name).distinct().withColumn("_r", F.lit(True))
    j = w.join(r, name, "full_outer")
    action = F.when(F.col("_r").isNull(), F.lit(CREATE)).when(F.col("_w").isNull(), F.lit(DROP))
    return j.select(name, action.alias("action")).filter(F.col("action").isNotNull())


def label_set_diff(write_labels: Column, read_labels: Column) -> Column:
    """D3: write labels missing from read, write order kept; nothing is removed."""
    return F.array_except(write_labels, read_labels)


def snapshot_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset equality; one row (n_missing, n_extra, is_equal).

    Same answer as ``exceptAll`` both ways, in one shuffle: rows of ``a`` count +1,
    rows of ``b`` -1, summed per distinct row (grouping is null-safe, and copies
    of a row collapse in the map-side partial aggregate).  A positive net is a
    row missing from ``b``, a negative one a row extra in ``b``.
    """
    net = signed_row_counts(a, b)
    counts = net.agg(
        F.coalesce(F.sum(F.when(F.col("_net") > 0, F.col("_net"))), F.lit(0)).cast("bigint").alias("n_missing"),
        F.coalesce(F.sum(F.when(F.col("_net") < 0, -F.col("_net"))), F.lit(0)).cast("bigint").alias("n_extra"))
    return counts.select("n_missing", "n_extra",
                         ((F.col("n_missing") == 0) & (F.col("n_extra") == 0)).alias("is_equal"))


def signed_row_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per distinct row: (count in a) - (count in b), as ``_net``; only rows with ``_net != 0``."""
    cols = a.columns
    t = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    return t.groupBy(*cols).agg(F.sum("_d").alias("_net")).filter(F.col("_net") != 0)
