"""Grouped aggregates the reference uses beyond counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_array_agg(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A4: ``array_agg(value ORDER BY order)`` per group, as ``<value>_list``.

    ``collect_list`` is partially aggregated map-side; the sort happens once per
    group on (order, value) structs.  The output row holds the group's array, so
    the operator is meant for bounded groups (a catalog entry, a conversation).
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias(f"{value}_list"))


def ordered_positions(df: DataFrame, keys: list[str], order: list[str], value: str,
                      skew_safe: bool = True) -> DataFrame:
    """A4 in long form: ``keys + ordinality + value``, the 1-based position of each
    value in its group's ``ORDER BY`` sequence.  Carries the same information as
    the array without collecting any group into one row; positions come from the
    skew-safe ordered scan, so a huge group is spread over many tasks."""
    from .scan import ordered_scan
    s = ordered_scan(df.select(*keys, *[c for c in order if c not in keys], value), keys, order,
                     sums={"ordinality": F.lit(1).cast("bigint")}, inclusive=True, skew_safe=skew_safe)
    return s.select(*keys, F.col("ordinality").cast("bigint").alias("ordinality"), value)


def non_empty(df: DataFrame) -> bool:
    """A5: ``COUNT(*) > 0`` without counting: stops at the first row."""
    return not df.isEmpty()


def exists_in(df: DataFrame, probe: DataFrame, cols: list[str]) -> DataFrame:
    """Probe rows with an ``exists`` flag (left join to distinct keys)."""
    k = df.select(*cols).distinct().withColumn("exists", F.lit(True))
    return probe.join(k, cols, "left").withColumn("exists", F.coalesce(F.col("exists"), F.lit(False)))
