"""A replica in key buckets behind a manifest: a change batch rewrites only the buckets it touches.

Layout under ``<root>/<name>``:

* ``data/w=<write>/_bucket=<b>/``   the file set of bucket b made by one write.  A row holds the table's columns,
  the sequence number last applied to its key (``_seq``) and whether the key is deleted (``_deleted``), so the
  marks that keep late changes out live in the same files as the rows.
* ``<name>.manifest`` (a snapshot table)  one row a bucket naming its file set, and one row (bucket -1) with the
  schema.  Publishing a version of it is the only commit: a write that stops earlier leaves files that no manifest
  names, and readers keep the old table.

The number of buckets is fixed when the table is made and bounds what the driver holds: the manifest and the list
of touched buckets.  A bucket should hold about as many bytes as a task can sort (0.1-1 GB).  There is one writer
at a time; a second one that publishes the same manifest version fails.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import _fs, publish_snapshot, read_snapshot, snapshot_versions

BUCKET, SEQ, GONE = "_bucket", "_seq", "_deleted"
LOWEST = -(1 << 63)  # the mark of rows that no change has touched


@dataclass(frozen=True)
class Applied:
    """What one batch did: the manifest version it made (None if it had no changes) and the buckets it rewrote."""

    version: int | None
    buckets: tuple[int, ...]


@dataclass(frozen=True)
class BucketedTable:
    root: str
    name: str
    keys: tuple[str, ...]
    buckets: int = 64

    # -- layout ----------------------------------------------------------------

    @property
    def _marks(self) -> str:
        return f"{self.name}.manifest"

    def _path(self, file_set: str) -> str:
        return f"{self.root.rstrip('/')}/{self.name}/data/{file_set}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self, spark: SparkSession) -> list[int]:
        return snapshot_versions(spark, self.root, self._marks)

    def manifest(self, spark: SparkSession, version: int | None = None) -> tuple[T.StructType, dict[int, str]]:
        """Schema of the stored rows and the file set of every bucket that has one (at most ``buckets`` rows)."""
        rows = {r["bucket"]: r["files"] for r in read_snapshot(spark, self.root, self._marks, version).collect()}
        return T._parse_datatype_json_string(rows.pop(-1)), rows

    def _commit(self, spark: SparkSession, schema: T.StructType, sets: dict[int, str]) -> int:
        rows = spark.createDataFrame([(-1, schema.json()), *sorted(sets.items())], "bucket int, files string")
        return publish_snapshot(rows.coalesce(1), self.root, self._marks)

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Write ``rows`` (with their bucket) as new file sets; the buckets that got one."""
        spark, write = rows.sparkSession, f"w={uuid.uuid4().hex}"
        rows.write.partitionBy(BUCKET).parquet(self._path(write))
        fs, p = _fs(spark, self._path(write))
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return {int(n.split("=")[1]): f"{write}/{n}" for n in names if n.startswith(BUCKET + "=")}

    def _stored(self, spark: SparkSession, schema: T.StructType, sets: list[str]) -> DataFrame:
        if not sets:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[self._path(s) for s in sets])

    # -- the table -------------------------------------------------------------

    def create(self, rows: DataFrame) -> int:
        """The first version: ``rows``, one for each key."""
        stored = rows.withColumn(SEQ, F.lit(LOWEST)).withColumn(GONE, F.lit(False))
        # "nullable" everywhere: a deleted key keeps its key columns only
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in stored.schema.fields])
        sets = self._write(stored.withColumn(BUCKET, self._bucket()).repartition(BUCKET))
        return self._commit(rows.sparkSession, schema, sets)

    def read(self, spark: SparkSession, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The live rows of a version (the newest by default), of all buckets or of some."""
        schema, sets = self.manifest(spark, version)
        chosen = sorted(s for b, s in sets.items() if buckets is None or b in set(buckets))
        return self._stored(spark, schema, chosen).filter(~F.col(GONE)).drop(SEQ, GONE)

    def apply(self, changes: DataFrame, seq: str = "seq", op: str = "op", row: str = "row", forget_below: int | None = None) -> Applied:
        """Fold a batch of changes (keys, ``seq``, ``op`` upsert or delete, ``row`` struct) into the buckets of its keys.

        The change with the highest number wins, whether it is in the batch or was applied earlier, so batches may
        come late, twice or in any order.  Numbers are longs.  ``forget_below``: deleted keys with lower marks are
        dropped when their bucket is rewritten; use it when no older change can still come.

        One shuffle, of the batch reduced to a change a key and of the touched buckets.
        """
        spark = changes.sparkSession
        schema, sets = self.manifest(spark)
        columns = [f.name for f in schema.fields if f.name not in (SEQ, GONE)]
        values = [c for c in columns if c not in self.keys]
        last = changes.groupBy(*self.keys).agg(F.max_by(F.struct(F.col(op).alias("op"), F.col(row).alias("row")), F.col(seq)).alias("c"),
                                               F.max(F.col(seq)).cast("long").alias(SEQ))
        gone = F.col("c.op") == "delete"
        last = last.select(*self.keys, *[F.when(~gone, F.col("c.row")[c]).cast(schema[c].dataType).alias(c) for c in values],
                           SEQ, gone.alias(GONE), self._bucket().alias(BUCKET)).checkpoint(eager=True)
        touched = sorted(r[0] for r in last.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return Applied(None, ())
        old = self._stored(spark, schema, [sets[b] for b in touched if b in sets]).withColumn(BUCKET, self._bucket())
        both = old.unionByName(last).repartition(BUCKET)
        newest = both.groupBy(BUCKET, *self.keys).agg(F.max_by(F.struct(*values, GONE), SEQ).alias("n"), F.max(SEQ).alias(SEQ))
        newest = newest.select(*[c if c in self.keys else F.col("n")[c].alias(c) for c in columns], SEQ, F.col("n")[GONE].alias(GONE), BUCKET)
        if forget_below is not None:
            newest = newest.filter(~F.col(GONE) | (F.col(SEQ) >= forget_below))
        written = self._write(newest)
        kept = {b: s for b, s in sets.items() if b not in set(touched)}
        return Applied(self._commit(spark, schema, kept | written), tuple(touched))

    # -- incremental sync from a write side ----------------------------------------

    def _upserts(self, rows: DataFrame, seq: int) -> DataFrame:
        return rows.select(*self.keys, F.lit(seq).cast("long").alias("seq"), F.lit("upsert").alias("op"), F.struct(*[F.col(c) for c in rows.columns]).alias("row"))

    def _deletes(self, ids: DataFrame, seq: int, like: DataFrame) -> DataFrame:
        return ids.select(*self.keys, F.lit(seq).cast("long").alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast(like.schema["row"].dataType).alias("row"))

    def sync_rows(self, ids: DataFrame, write: DataFrame, seq: int) -> tuple[Applied, DataFrame]:
        """M8: take over the write side's rows of the given keys; the keys it lacks come back as a frame."""
        wanted, keys = ids.select(*self.keys).distinct(), list(self.keys)
        done = self.apply(self._upserts(write.join(wanted, keys, "left_semi"), seq))
        return done, wanted.join(write.select(*keys), keys, "left_anti")

    def delete_rows(self, ids: DataFrame, seq: int) -> Applied:
        """Delete the given keys."""
        like = self._upserts(self.read(ids.sparkSession), seq)
        return self.apply(self._deletes(ids.select(*self.keys).distinct(), seq, like))

    def sync_children(self, parents: DataFrame, write: DataFrame, fk: str, parent_key: str, seq: int) -> Applied:
        """M9: make the children of the given parents equal to the write side's.  Finding them reads key and ``fk`` columns
        of the whole table (children are not in their parent's bucket); only buckets of changed keys are rewritten."""
        spark, keys = parents.sparkSession, list(self.keys)
        p = parents.select(F.col(parent_key).alias(fk)).distinct()
        fresh = self._upserts(write.join(p, fk, "left_semi").select(*self.read(spark).columns), seq)
        gone = self.read(spark).select(*dict.fromkeys([*keys, fk])).join(p, fk, "left_semi").join(fresh.select(*keys), keys, "left_anti")
        return self.apply(fresh.unionByName(self._deletes(gone, seq, fresh)))

    # -- retention -------------------------------------------------------------------

    def vacuum(self, spark: SparkSession, keep: int = 2) -> int:
        """Drop all manifests but the newest ``keep`` and the file sets that none of those names (files of failed
        writes too); the number of file sets dropped.  Not to be run beside a write or a reader of an older version."""
        versions = self.versions(spark)
        named = {s for v in versions[-keep:] for s in self.manifest(spark, v)[1].values()}
        fs, base = _fs(spark, self._path(""))
        for v in versions[:-keep]:
            fs.delete(_fs(spark, f"{self.root.rstrip('/')}/{self._marks}/v={v}")[1], True)
        dropped = 0
        for write in fs.listStatus(base) if fs.exists(base) else []:
            sets = [s.getPath() for s in fs.listStatus(write.getPath()) if s.isDirectory()]
            stale = [s for s in sets if f"{write.getPath().getName()}/{s.getName()}" not in named]
            dropped += len(stale)
            for s in [write.getPath()] if len(stale) == len(sets) else stale:
                fs.delete(s, True)
        return dropped
