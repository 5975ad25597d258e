"""Helpers shared by the operators of this package.

Words are maximal runs without the six ASCII white-space bytes (space and
0x09-0x0D).  UTF-8 never uses those bytes inside a longer sequence, so words can
be cut on the raw bytes of an Arrow string column, many documents at a time.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One white-space run, in the syntax that Java, Python and RE2 share.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: The same characters one by one, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that a worker turns into numpy arrays at a time.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas of ``body``.

    The optimizer may copy a projected expression into every place that names it;
    a lambda variable cannot be copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def checkpoint_ready(spark: SparkSession) -> None:
    """Point the context at the session's shared ``spark.checkpoint.dir``; a folder of
    the package's own (local sessions only) where that is unset."""
    from twinlake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)


def pin(df: DataFrame, rows_per_batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.  ``rows_per_batch`` bounds the Arrow
    batches of this one job, for rows that are large."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    checkpoint_ready(spark)
    before = spark.conf.get(name)
    if rows_per_batch:
        spark.conf.set(name, str(rows_per_batch))
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def _kept(name: str) -> dict:
    """A dict that lives as long as the Python worker.  Globals of functions pickled by value last for one task only."""
    name = f"_twinlake_{name}"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    return sys.modules[name].kept


def worker_cache(owner: str, key, make):
    """``make()`` for the last key of the last owner that a worker served.  Workers outlive queries, so what other
    owners or keys left goes, and a worker never holds more than one operator's cache."""
    kept = _kept("cache")
    if kept.get("of") != (owner, key):
        kept.clear()
        kept |= {"of": (owner, key), "value": make()}
    return kept["value"]


# -- words of many documents at once ---------------------------------------

def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [a, b) of about ``limit`` bytes each; one longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def _tables() -> dict:
    own = _kept("tables")
    if not own:
        rng = np.random.default_rng(0x5EED)
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        own |= {"word": ~space, "lower": lower, "value": rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64),
                "base": np.uint64(0x9E3779B97F4A7C15), "powers": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}
    return own


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    own = _tables()
    if len(own["powers"]) < n:
        size, base = max(n, SLICE_BYTES + 1), int(own["base"])
        for name, b in (("powers", base), ("inverse", pow(base, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            own[name] = np.cumprod(x, dtype=np.uint64)
    return own["powers"][:n], own["inverse"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer on 64-bit values (shift, multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the given rows, in order, and the n + 1 word offsets of the rows."""
    own, a = _tables(), int(offsets[0])
    x = data[a: int(offsets[-1])]
    bounds = offsets - a
    if not len(x):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if fold_case:
        x = own["lower"][x]
    word = own["word"][x]
    cut = np.zeros(len(x) + 1, bool)  # a row begins here
    cut[bounds] = True
    edge = np.empty(len(x) + 1, bool)
    edge[0], edge[-1] = word[0], word[-1]
    edge[1:-1] = word[1:] != word[:-1]
    edge[1:-1] |= cut[1:-1] & word[1:] & word[:-1]
    first = np.flatnonzero(word & (edge[:-1]))
    last = np.flatnonzero(word & (edge[1:])) + 1
    powers, inverse = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(own["value"][x] * powers[:-1], out=sums[1:])
    h = (sums[last] - sums[first]) * inverse[first]
    h = mix64(h ^ ((last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return h, np.searchsorted(first, bounds).astype(np.int64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence where it is shorter; none of nothing."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    h = words[:m].copy()
    for j in range(1, n):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + words[j: j + m])
    return h
