"""Incremental replica apply from a change stream.

Each micro-batch is folded into the replica with the batch operator
``merge.apply_changes`` (last change per key wins, deletes remove, upserts
replace) and published as a new snapshot version.  The last sequence number of
each key is published beside the table (``<table>.seq``), so a change that arrives
in a later batch than a newer one of its key is left out.  Re-running a batch after
a failure is harmless: applying the same changes to the same keys again yields the
same table.

``cdc_sink`` rewrites the table for each batch and suits small tables;
``bucketed_sink`` rewrites only the buckets that a batch touches, rows and marks in
one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import apply_changes
from ..sources.buckets import BucketedTable
from ..sources.tables import publish_snapshot, read_snapshot, snapshot_versions


def newer_changes(changes: DataFrame, seen: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The changes whose sequence number is above the last one applied to their key."""
    last = seen.select(*keys, F.col(seq).alias("_seen"))
    return changes.join(last, keys, "left").filter(F.col("_seen").isNull() | (F.col(seq) > F.col("_seen"))).select(*changes.columns)


def cdc_sink(read_root: str, table: str, keys: list[str], seq: str = "seq"):
    """``foreachBatch`` function: apply the batch's changes to the newest snapshot."""
    marks = f"{table}.seq"

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = read_snapshot(spark, read_root, table)
        last = batch.select(*keys, seq)
        if snapshot_versions(spark, read_root, marks):
            seen = read_snapshot(spark, read_root, marks)
            batch = newer_changes(batch, seen, keys, seq)
            last = last.unionByName(seen)
        publish_snapshot(apply_changes(current, batch, keys, seq), read_root, table)
        publish_snapshot(last.groupBy(*keys).agg(F.max(seq).alias(seq)), read_root, marks)
    return apply


def bucketed_sink(table: BucketedTable, seq: str = "seq", op: str = "op", row: str = "row", forget_below: int | None = None):
    """``foreachBatch`` function: apply the batch's changes to the buckets of its keys."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, seq, op, row, forget_below)
    return apply
