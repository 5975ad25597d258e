"""Row diff that reads only the buckets that differ (D1, D6): digests kept beside bucketed tables.

``DigestedTable`` keeps, beside a :class:`BucketedTable`, one digest for each bucket *and file set*.  A file set never
changes once written, so its digest never does: after a change batch only the new file sets are read again, and the
digests of all others are taken over.  A bucket's digest is its number of live rows and four sums over SHA-256 words
of the rows: it does not depend on the rows' order or on how files are split, partial sums are taken on the map side,
and one row holds it.

Two tables with the same keys, columns and number of buckets hold a key in the same bucket number, so ``pruned_row_diff``
compares the digests (a row for each bucket), takes buckets with equal ones as ``same`` and joins only the others.
Of buckets with equal digests at most the key columns of one side are read, to list their keys (``same=True``).
Tables that are equal are found equal without reading a row of them.

Equal digests of different rows need 256 bits to collide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import SAME, row_diff
from .buckets import BUCKET, BucketedTable
from .tables import publish_snapshot, read_snapshot, snapshot_versions

WORDS = tuple(f"_w{i}" for i in range(4))


def row_words(columns: list[str]) -> list[Column]:
    """Four decimals of 64 bits each from the SHA-256 of a row.  Each value is JSON after its length, so null, the empty
    text and values that hold separators stay apart; nested values and microseconds count in full."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

    def field(c: str) -> Column:
        text = F.to_json(F.struct(F.col(c).alias("v")), exact)
        return F.concat(F.length(text).cast("string"), F.lit(":"), text)

    digest = F.sha2(F.concat(*[field(c) for c in columns]), 256)
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]


@dataclass(frozen=True)
class DigestedTable:
    table: BucketedTable

    @property
    def _name(self) -> str:
        return f"{self.table.name}.digests"

    def _kept(self, spark: SparkSession) -> dict[str, tuple]:
        """File set -> digest, of the newest snapshot (at most a row for each bucket)."""
        if not snapshot_versions(spark, self.table.root, self._name):
            return {}
        return {r["files"]: (r["n"], r["digest"]) for r in read_snapshot(spark, self.table.root, self._name).collect()}

    def refresh(self, spark: SparkSession) -> tuple[dict[int, tuple], list[int]]:
        """Digests of every bucket of the newest version, and the buckets whose rows were read for them."""
        _, sets = self.table.manifest(spark)
        kept = self._kept(spark)
        stale = sorted(b for b, files in sets.items() if files not in kept)
        if stale:
            rows = self.table.read(spark, buckets=stale)
            columns = sorted(rows.columns)
            words = rows.select(self.table._bucket().alias(BUCKET), *[w.alias(n) for w, n in zip(row_words(columns), WORDS, strict=True)])
            # sums as decimal(38): exact for 10^18 rows of a bucket
            sums = words.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(w).cast("decimal(38,0)")).alias(w) for w in WORDS])
            read = {r[BUCKET]: (r["n"], ",".join(str(r[w]) for w in WORDS)) for r in sums.collect()}  # at most `buckets` rows
            kept |= {sets[b]: read.get(b, (0, "")) for b in stale}  # a bucket of deleted keys only has no row
            current = [(files, *kept[files]) for files in sorted(sets.values())]
            publish_snapshot(spark.createDataFrame(current, "files string, n bigint, digest string").coalesce(1), self.table.root, self._name)
        return {b: kept[files] for b, files in sets.items()}, stale


def differing_buckets(spark: SparkSession, write: DigestedTable, read: DigestedTable) -> list[int]:
    """The numbers of the buckets whose live rows differ; an absent bucket equals an empty one."""
    w, r = write.table, read.table
    if (w.keys, w.buckets) != (r.keys, r.buckets):
        raise ValueError("tables to compare have the same keys and number of buckets")
    ours, theirs = write.refresh(spark)[0], read.refresh(spark)[0]
    none = (0, "")
    return sorted(b for b in ours.keys() | theirs.keys() if ours.get(b, none) != theirs.get(b, none))


def pruned_row_diff(spark: SparkSession, write: DigestedTable, read: DigestedTable, same: bool = True) -> DataFrame:
    """D1 on stored tables: the rows of ``diff.row_diff``, its join over the buckets that differ only.

    ``same=False`` leaves out the rows that are equal on both sides and reads nothing of equal buckets.  Both tables
    have the same columns; types are compared as written.
    """
    w, r = write.table, read.table
    different = differing_buckets(spark, write, read)
    keys = list(w.keys)
    diff = row_diff(w.read(spark, buckets=different), r.read(spark, buckets=different), keys)
    if not same:
        return diff.filter(F.col("action") != SAME)
    equal = sorted(set(w.manifest(spark)[1]) - set(different))
    return diff.unionByName(w.read(spark, buckets=equal).select(*keys, F.lit(SAME).alias("action")))


def bucket_counts(spark: SparkSession, write: DigestedTable, read: DigestedTable) -> DataFrame:
    """D6 by bucket: live rows of both sides and whether they are equal, from the digests alone."""
    ours, theirs, none = write.refresh(spark)[0], read.refresh(spark)[0], (0, "")
    rows = [(b, ours.get(b, none)[0], theirs.get(b, none)[0], ours.get(b, none) == theirs.get(b, none)) for b in range(write.table.buckets)]
    return spark.createDataFrame(rows, "bucket int, n_write bigint, n_read bigint, is_equal boolean")


def snapshots_equal(spark: SparkSession, write: DigestedTable, read: DigestedTable) -> bool:
    """Whether both tables hold the same live rows."""
    return not differing_buckets(spark, write, read)

