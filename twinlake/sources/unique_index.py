"""Unique columns kept by an index beside a bucketed replica (M7 for change batches).

The index is a bucketed table of its own: unique value -> key of the row that holds it.  A batch is judged by the values
it touches (those its rows take and those they give up); only their index buckets and the buckets of the changed keys
are read and written, never the rest of the table.

A batch is judged as a whole: two rows that swap their values clash only in passing.  Of rows that want one value after
the batch, a row that holds it and does not give it up comes first, then the change with the lowest number; the others
are refused and their rows stay as they were.  A refused row keeps its old value, which may refuse another row that
wanted that value: refusals are repeated until there are no new ones.  They only grow, so this ends.

The index names the table version it belongs to.  If a writer stopped between the two commits, the next batch finds the
versions apart and rebuilds the index from the table.  Null values (in any unique column) never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import BUCKET, GONE, LOWEST, SEQ, Applied, BucketedTable
from .tables import publish_snapshot, read_snapshot, snapshot_versions


class UniqueClash(ValueError):
    pass


@dataclass(frozen=True)
class UniqueReplica:
    table: BucketedTable
    unique: tuple[str, ...]

    @property
    def index(self) -> BucketedTable:
        t = self.table
        return BucketedTable(t.root, f"{t.name}.by.{'.'.join(self.unique)}", ("value",), t.buckets)

    @property
    def _belongs(self) -> str:
        return f"{self.index.name}.of"

    def _value(self, row: str | None = None):
        cols = [F.col(row)[u] if row else F.col(u) for u in self.unique]
        some = F.lit(True)
        for c in cols:
            some = some & c.isNotNull()
        return F.when(some, F.to_json(F.struct(*[c.cast("string").alias(u) for c, u in zip(cols, self.unique, strict=True)])))

    def _holders(self, rows: DataFrame) -> DataFrame:
        return rows.select(self._value().alias("value"), F.struct(*self.table.keys).alias("holder")).filter("value IS NOT NULL")

    def _mark(self, spark: SparkSession) -> None:
        row = spark.createDataFrame([(self.table.versions(spark)[-1],)], "version long")
        publish_snapshot(row.coalesce(1), self.table.root, self._belongs)

    # -- making and reading ----------------------------------------------------------

    def create(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        held = self._holders(rows)
        if held.groupBy("value").count().filter("count > 1").limit(1).count():
            raise UniqueClash(f"{self.table.name}: {list(self.unique)} is not unique")
        self.table.create(rows)
        self.index.create(held)
        self._mark(spark)

    def current(self, spark: SparkSession) -> bool:
        """Whether the index belongs to the table's newest version."""
        if not snapshot_versions(spark, self.table.root, self._belongs):
            return False
        return read_snapshot(spark, self.table.root, self._belongs).first()["version"] == self.table.versions(spark)[-1]

    def rebuild(self, spark: SparkSession) -> None:
        """The index anew from the table."""
        self.index.create(self._holders(self.table.read(spark)))
        self._mark(spark)

    # -- a batch ----------------------------------------------------------------------

    def apply(self, changes: DataFrame, seq: str = "seq", op: str = "op", row: str = "row") -> tuple[Applied, DataFrame]:
        """Fold a batch into table and index; what it did, and the refused changes (keys, ``seq``, ``value`` wanted, ``holder``)."""
        spark, t, keys = changes.sparkSession, self.table, list(self.table.keys)
        if not self.current(spark):
            self.rebuild(spark)
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(F.col(op).alias("op"), F.col(row).alias("row")), F.col(seq)).alias("c"), F.max(F.col(seq)).cast("long").alias("seq"))
        last = last.select(*keys, "seq", "c.op", "c.row").withColumn(BUCKET, t._bucket()).checkpoint(eager=True)
        touched = [r[0] for r in last.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        schema, sets = t.manifest(spark)
        stored = t._stored(spark, schema, [sets[b] for b in touched if b in sets])
        old = stored.select(*keys, F.when(~F.col(GONE), self._value()).alias("old"), F.col(SEQ).alias("mark"))
        deltas = last.join(old, keys, "left").filter(F.coalesce("mark", F.lit(LOWEST)) < F.col("seq"))
        deltas = deltas.select(*keys, F.struct(*keys).alias("k"), "seq", "op", "row", "old", F.when(F.col("op") != "delete", self._value("row")).alias("new"))
        deltas = deltas.checkpoint(eager=True)

        values = deltas.select(F.col("old").alias("value")).unionByName(deltas.select(F.col("new").alias("value"))).filter("value IS NOT NULL").distinct()
        values = values.checkpoint(eager=True)
        near = [r[0] for r in values.select(self.index._bucket()).distinct().collect()]  # at most ``buckets`` numbers
        held = self.index.read(spark, buckets=near).join(values, "value", "left_semi").join(deltas.select(F.col("k").alias("holder")), "holder", "left_anti")
        still = held.select("value", F.col("holder").alias("k"), F.lit(0).alias("rank"), F.lit(LOWEST).alias("seq")).checkpoint(eager=True)

        refused = spark.createDataFrame([], deltas.select("k").schema)
        n = 0
        while True:
            judged = deltas.join(refused.withColumn("_no", F.lit(True)), "k", "left").withColumn("_no", F.col("_no").isNotNull())
            stays = F.col("_no") | F.col("old").eqNullSafe(F.col("new"))
            claims = judged.select(F.when(stays, F.col("old")).otherwise(F.col("new")).alias("value"), "k", F.when(stays, 0).otherwise(1).alias("rank"),
                                   F.when(stays, F.lit(LOWEST)).otherwise(F.col("seq")).alias("seq")).filter("value IS NOT NULL").unionByName(still)
            winner = claims.groupBy("value").agg(F.min(F.struct("rank", "seq", "k")).alias("w"))
            more = claims.filter("rank = 1").join(winner, "value").filter(F.col("k") != F.col("w.k")).select(F.struct(*[F.col("k")[c].alias(c) for c in keys]).alias("k"))
            refused = refused.unionByName(more).distinct().checkpoint(eager=True)
            now = refused.count()
            if now == n:
                break
            n = now
        done = t.apply(deltas.join(refused, "k", "left_anti").select(*keys, "seq", "op", "row"))
        if done.version is not None:
            # the net holder of each touched value; numbered by the table's version, as one value may pass between keys in a batch
            net = values.join(winner, "value", "left").select(
                "value", F.lit(done.version).cast("long").alias("seq"), F.when(F.col("w").isNull(), "delete").otherwise("upsert").alias("op"),
                F.struct("value", F.col("w.k").alias("holder")).alias("row"))
            self.index.apply(net)
            self._mark(spark)
        out = deltas.join(refused, "k", "left_semi").join(winner.select(F.col("value").alias("new"), F.col("w.k").alias("holder")), "new", "left")
        return done, out.select(*keys, "seq", F.col("new").alias("value"), "holder")
