"""Exact deduplication with a cuckoo-filter index over live digests.

Texts are equal when their normalised forms (each white-space run as one space)
are.  Spark computes the SHA-256 of that form, tasks reduce their own rows to one
entry a digest, and entries are dealt by digest to index buckets.  A bucket is a
cuckoo filter (16-bit fingerprints, two candidate cells of four) beside the content
it stands for: the stored digests.  An entry whose fingerprint is absent is new
and is inserted; a hit is verified against the stored digest, so a fingerprint
shared by chance never merges two texts.  Deleting the last live copy of a digest
takes its fingerprint out.  When an insertion finds no free cell after
``MAX_KICKS`` moves, the filter doubles and is refilled from the stored digests.

Results in special cases
* Null text counts as empty; empty texts are equal to each other.
* Of equal texts the row with the smallest id stays; of repeated rows with that
  id, one.  A null id is larger than any other.
* Only id and text are read; other columns are carried by ``deduplicated``.
* Empty table: empty result.
* A group of any size: tasks send one entry a digest, and the join that gives
  rows their group splits hot digests (AQE skew join).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import SPACE_RUN, documents, pin

#: Digests that one index bucket should hold; bounds a task's memory (about 300 bytes a digest).
DIGESTS_PER_BUCKET = 100_000
CELLS = 4
MAX_KICKS = 500


class CuckooFilter:
    """Partial-key cuckoo filter over 32-byte digests."""

    def __init__(self, n_buckets: int = 1024):
        self.n = 1 << max(1, (n_buckets - 1).bit_length())
        self.cells = np.zeros((self.n, CELLS), np.uint16).tolist()
        self.size = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[:2], "little") or 1
        i = int.from_bytes(digest[2:10], "little") & (self.n - 1)
        return fp, i, self._other(i, fp)

    def _other(self, i: int, fp: int) -> int:
        return (i ^ (fp * 0x5BD1E995)) & (self.n - 1)

    def may_contain(self, digest: bytes) -> bool:
        fp, i, j = self._places(digest)
        return fp in self.cells[i] or fp in self.cells[j]

    def insert(self, digest: bytes) -> bool:
        """False on overflow; the filter then lacks one fingerprint and must be rebuilt."""
        fp, i, j = self._places(digest)
        self.size += 1
        for b in (i, j):
            if 0 in self.cells[b]:
                self.cells[b][self.cells[b].index(0)] = fp
                return True
        at = j
        for kick in range(MAX_KICKS):
            cell = self.cells[at]
            k = (kick + fp) % CELLS
            fp, cell[k] = cell[k], fp
            at = self._other(at, fp)
            if 0 in self.cells[at]:
                self.cells[at][self.cells[at].index(0)] = fp
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        fp, i, j = self._places(digest)
        for b in (i, j):
            if fp in self.cells[b]:
                self.cells[b][self.cells[b].index(fp)] = 0
                self.size -= 1
                return True
        return False


class DigestIndex:
    """One bucket of the index: the filter and the content that verifies its hits."""

    def __init__(self, n_buckets: int = 1024):
        self.filter = CuckooFilter(n_buckets)
        self.stored: dict[bytes, list] = {}  # digest -> [live copies, keeper]
        self.false_hits = self.resizes = 0

    def insert(self, digest: bytes, copies: int, keeper) -> bool:
        """True if the digest is new."""
        if self.filter.may_contain(digest):
            entry = self.stored.get(digest)
            if entry is not None:
                entry[0] += copies
                if keeper < entry[1]:
                    entry[1] = keeper
                return False
            self.false_hits += 1
        self.stored[digest] = [copies, keeper]
        if not self.filter.insert(digest):
            self._resize()
        return True

    def delete(self, digest: bytes, copies: int = 1) -> bool:
        """True if the digest was live.  Its fingerprint goes with the last copy; two digests that share a
        fingerprint and cells have two equal entries, of which one goes."""
        entry = self.stored.get(digest) if self.filter.may_contain(digest) else None
        if entry is None:
            return False
        entry[0] -= copies
        if entry[0] <= 0:
            del self.stored[digest]
            self.filter.delete(digest)
        return True

    def _resize(self) -> None:
        n = self.filter.n
        while True:
            n *= 2
            self.resizes += 1
            self.filter = CuckooFilter(n)
            if all(self.filter.insert(d) for d in self.stored):
                return


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _digest): SHA-256 of the normalised text, JVM-side."""
    normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " ")
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.unhex(F.sha2(normal, 256)).alias("_digest"))


ENTRY = "_bucket int, _digest binary, _copies long, _keep_id long, _keep_row long"
NO_ID = 2 ** 63 - 1  # in place of a null id, larger than any other


def _reduce(n_buckets: int):
    """One entry a digest of each Arrow batch: copies and the smallest (id, row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for d, i, r in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key = (NO_ID if i is None else i, r)
                entry = found.get(d)
                if entry is None:
                    found[d] = [1, key]
                else:
                    entry[0] += 1
                    if key < entry[1]:
                        entry[1] = key
            yield pa.RecordBatch.from_arrays([
                pa.array([int.from_bytes(d[-8:], "little") % n_buckets for d in found], pa.int32()), pa.array(found, pa.binary()),
                pa.array([e[0] for e in found.values()], pa.int64()), pa.array([e[1][0] for e in found.values()], pa.int64()),
                pa.array([e[1][1] for e in found.values()], pa.int64())], ["_bucket", "_digest", "_copies", "_keep_id", "_keep_row"])

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All entries of some buckets, through the index; what is live at the end."""
    index = DigestIndex()
    for batch in batches:
        for d, n, i, r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
            index.insert(d, n, (i, r))
    live = list(index.stored.items())
    for a in range(0, len(live), 50_000):
        part = live[a: a + 50_000]
        yield pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in part], pa.binary()), pa.array([e[0] for _, e in part], pa.int64()),
            pa.array([e[1][0] for _, e in part], pa.int64()), pa.array([e[1][1] for _, e in part], pa.int64())],
            ["_digest", "_copies", "_keep_id", "_keep_row"])


def groups(rows: DataFrame, digests_per_bucket: int = DIGESTS_PER_BUCKET) -> DataFrame:
    """(_digest, _copies, _keep_id, _keep_row) of rows (_id, _digest, _row), through the bucketed index."""
    n = max(1, -(-rows.count() // digests_per_bucket))
    entries = rows.select("_id", "_digest", "_row").mapInArrow(_reduce(n), ENTRY)
    return entries.repartition(n, "_bucket").mapInArrow(_index, "_digest binary, _copies long, _keep_id long, _keep_row long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests_per_bucket: int = DIGESTS_PER_BUCKET) -> DataFrame:
    """One row a document: _id, _row, _digest, _copies, _keep_id, _kept."""
    rows = pin(digests(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    out = rows.join(groups(rows, digests_per_bucket), "_digest")
    return out.select("_id", "_row", "_digest", "_copies", F.when(F.col("_keep_id") != NO_ID, F.col("_keep_id")).alias("_keep_id"),
                      (F.col("_row") == F.col("_keep_row")).alias("_kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns, by an anti join with the ids and digests that go.

    Rows that repeat a keeper's id and text are told apart by nothing, so where there are any, one row
    of each such digest is taken.
    """
    found = pin(grouped(docs, id_col, text_col).filter(~F.col("_kept")).select("_id", "_digest", "_keep_id"))
    again = F.col("_id").eqNullSafe(F.col("_keep_id"))
    gone = found.filter(~again).select(F.col("_id").alias("_gone_id"), F.col("_digest").alias("_gone")).distinct()
    twice = found.filter(again).select(F.col("_digest").alias("_twice")).distinct()
    mine = F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " "), 256))
    keyed = docs.withColumn("_twinlake_digest", mine)
    out = keyed.join(gone, keyed[id_col].cast("long").eqNullSafe(gone["_gone_id"]) & (keyed["_twinlake_digest"] == gone["_gone"]), "left_anti")
    if not twice.isEmpty():
        same = out["_twinlake_digest"] == twice["_twice"]
        out = out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates(["_twinlake_digest"]))
    return out.drop("_twinlake_digest")


def live_digests(log: DataFrame, id_col: str = "doc_id", text_col: str = "text", op_col: str = "op", seq_col: str = "seq",
                 digests_per_bucket: int = DIGESTS_PER_BUCKET) -> DataFrame:
    """Digests live after a log of insertions and deletions, with their copies: (text_sha256, copies).

    Deleting a digest that is not live does nothing.  Rows of a digest apply in the order of ``seq``
    (an insertion before a deletion on ties); runs of a task are not reduced, as their order counts.
    """
    n = max(1, -(-log.count() // digests_per_bucket))
    normal = F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " "), 256))
    rows = log.select(normal.alias("_digest"), (F.col(op_col) == "delete").alias("_del"), F.col(seq_col).cast("long").alias("_seq"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_digest"), F.lit(n)))

    def replay(batches):
        index = DigestIndex()
        for batch in batches:
            for d, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if gone:
                    index.delete(d)
                else:
                    index.insert(d, 1, (0, 0))
        yield pa.RecordBatch.from_arrays([pa.array([d.hex() for d in index.stored], pa.string()), pa.array([e[0] for e in index.stored.values()], pa.int64())],
                                         ["text_sha256", "copies"])

    return rows.repartition(n, "_bucket").sortWithinPartitions("_seq", "_del").mapInArrow(replay, "text_sha256 string, copies long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(documents(spark, sf_dir))
    return out.select(F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_copies").alias("group_size"),
                      F.col("_kept").alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


ORACLE = f"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE_RUN}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def normal_digest(text: str | None) -> str:
    """The digest of one text, for callers outside Spark."""
    import re

    return hashlib.sha256(re.sub(SPACE_RUN, " ", text or "").encode()).hexdigest()
