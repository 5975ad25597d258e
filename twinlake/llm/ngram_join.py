"""N-gram Jaccard join by T-occurrence search (DivideSkip over a distributed inverted index).

A text's set is its distinct n-word shingles (64-bit hashes).  Two sets link when
their Jaccard similarity reaches ``percent`` / 100, that is when they share at least
T = ceil(percent * (|x| + |y|) / (100 + percent)) shingles.

DivideSkip splits a query's inverted lists into short ones, which are merged, and
the longest L, which are only probed for documents that the merge found T - L
times.  With T - L = 1 the short lists of x are its |x| - T + 1 shortest, and the
first shingle that two linked sets share, by list length, is among these in both.

1. One scan gives each text a signature of its set; equal sets are one class, and
   only classes are searched.
2. Occurrences are counted before any pair is formed.  Inverted lists are built by
   shingle, and a shingle counts for a set if its list holds another component (at
   first, another class).  A set lacks at most |x| - ceil(t * |x|) shingles of a
   partner, so sets with more that do not count are out.  The first round looks at
   the lists of a fixed range of hashes, which rules out texts without a near copy.
3. Of the sets that are left, those that agree on two min-hashes are compared with
   two centres of their group: the one with the smallest id and the one with the
   least share of private shingles.  That joins most members of a large group of
   near copies to one component at linear cost; from here on only links between
   components matter, and two more rounds of counting leave few sets.
4. The last round gives the lengths of lists.  Shingles that count come after the
   others, by the lengths of their lists; the short lists are merged, and pairs of
   different components are candidates if sizes fit and at least T shingles of both
   come no earlier than the shared one.
5. Candidates are decided exactly: the larger set, which holds the long lists, is
   probed by binary search.  Links give components, over classes and then documents.

All links between different components are found, so the components are those of
all links.  Index tasks exchange packed arrays, not a row for each shingle.

Results in special cases
* Null and empty texts, and white space alone: 0 shingles, a component of their own.
* Texts of fewer than n words: one shingle, the whole sequence.
* Ties and repeated rows: equal texts share a component.  Null ids are allowed; a
  component's id is its smallest id that is not null.
* Only id and text are read.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .textkit import documents, mix64, pin, shingle_hashes, slices, utf8, word_hashes

#: List entries of an index task.
ENTRIES_PER_TASK = 1_000_000
#: Share of the hashes that the first round looks at, beyond what linked sets may have apart.
BAND_MARGIN = 0.1
#: Up to so many ids, those of the sets that are left are broadcast to filter the second reading; beyond it is a shuffle join.
BROADCAST_IDS = 1_000_000
#: Rows with whole sets that a worker holds at a time.
SETS_PER_BATCH = 256
#: Lists up to this length are paired by whole-array steps, longer ones row by row.
STEPPED = 32

SEEDS = [np.uint64(s) for s in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1)]


@dataclass(frozen=True)
class Rule:
    """Words of a shingle and the similarity in per cent, with the bounds that follow from them."""

    n: int
    percent: int

    @property
    def smallest(self) -> int:
        """Smaller sets link with equal sets only."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1 << 30

    @property
    def band(self) -> np.uint64:
        """Hashes under this limit are looked at in the first round."""
        share = min(1.0, 1 - self.percent / 100 + BAND_MARGIN)
        return np.uint64(min(int(share * 2 ** 64), 2 ** 64 - 1))

    def overlap(self, a, b):
        """T: shingles that sets of these sizes share at least if they link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def apart(self, size):
        """Shingles of a set that a linked set lacks, at most."""
        return size - (-(-self.percent * size // 100))


def shingle_sets(texts, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of an Arrow string column."""
    data, at = utf8(texts)
    for a, b in slices(at):
        words, bounds = word_hashes(data, at[a: b + 1], fold_case=True)
        runs = shingle_hashes(words, n) if len(words) >= n else None
        for i in range(b - a):
            s, e = bounds[i], bounds[i + 1]
            yield np.unique(runs[s: e - n + 1] if e - s >= n else shingle_hashes(words[s:e], n))


def _signature(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix64(s ^ seed).sum(dtype=np.uint64).view(np.int64)) for seed in SEEDS[:2])


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    """A record batch of rows with columns as in a Spark schema string of int, long and binary."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in columns.split(", ")]
    values = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], [f for f, _ in fields])


PROFILE = "_id long, n long, s1 long, s2 long, k1 long, k2 long, k3 long, k4 long, band long"


def _profile(rule: Rule, tagged: bool):
    """Size, signature and min-hashes of every row's set, and how many of its hashes are in the band; and, ``tagged``, the row's tag."""
    schema = PROFILE + ", tag binary" if tagged else PROFILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            tags = zip(batch.column(2).to_pylist()) if tagged else [()] * len(batch)
            for i, tag, s in zip(batch.column(0).to_pylist(), tags, shingle_sets(batch.column(1), rule.n), strict=True):
                if not len(s):
                    rows.append((i, 0, *[None] * 7, *tag))
                else:
                    low = [int(mix64(s ^ seed).min().view(np.int64)) for seed in SEEDS[2:]]
                    rows.append((i, len(s), *_signature(s), *low, int(np.searchsorted(s, rule.band)), *tag))
            yield _batch(rows, schema)

    return run


SETS = "s1 long, s2 long, words binary"


def _sets(rule: Rule, banded: bool):
    """Signature and hashes (those in the band, or all) of each set that can link; each class once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out, held = [], 0
            for s in shingle_sets(batch.column(0), rule.n):
                if len(s) < rule.smallest or (own := _signature(s)) in seen:
                    continue
                seen.add(own)
                words = s[: np.searchsorted(s, rule.band)] if banded else s
                out.append((*own, words.tobytes()))
                held += len(words)
                if held > ENTRIES_PER_TASK:
                    yield _batch(out, SETS)
                    out, held = [], 0
            yield _batch(out, SETS)

    return run


# -- packed entries, dealt to tasks -----------------------------------------

PACKED = "task int, a binary, b binary, c binary, d binary, e binary"


def _dealt(task: np.ndarray, n_tasks: int, arrays: list[np.ndarray]) -> Iterator[tuple]:
    """One PACKED row for each task that gets something."""
    order = np.argsort(task, kind="stable")
    bounds = np.searchsorted(task[order], np.arange(n_tasks + 1))
    for t in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[t]: bounds[t + 1]]
        yield (int(t), *[x[own].tobytes() for x in arrays], *[b""] * (5 - len(arrays)))


def _by_shingle(h: np.ndarray, n_tasks: int) -> np.ndarray:
    return ((h >> np.uint64(17)) % np.uint64(n_tasks)).astype(np.int32)


def _gathered(batches, kinds: list) -> list[np.ndarray]:
    parts: list[list[bytes]] = [[] for _ in kinds]
    for batch in batches:
        for k, p in enumerate(parts):
            p += batch.column(k + 1).to_pylist()
    return [np.frombuffer(b"".join(p), kind) for p, kind in zip(parts, kinds, strict=True)]


def _entries(n_tasks: int, limit: np.uint64 | None):
    """Rows (node, comp, n, words) as list entries (shingle, node), of hashes under the limit if there is one;
    and for nodes of larger components, node and component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, comp, size = (batch.column(k).to_numpy() for k in range(3))
            sets = [np.frombuffer(b, np.uint64) for b in batch.column(3).to_pylist()]
            if limit is not None:
                sets = [x[: np.searchsorted(x, limit)] for x in sets]
            h = np.concatenate([*sets, np.zeros(0, np.uint64)])
            row = np.repeat(np.arange(len(node)), [len(x) for x in sets])
            task = _by_shingle(h, n_tasks)
            order = np.argsort(task, kind="stable")
            bounds = np.searchsorted(task[order], np.arange(n_tasks + 1))
            out = []
            for t in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[t]: bounds[t + 1]]
                rows = np.unique(row[own])
                moved = rows[comp[rows] != node[rows]]
                out.append((int(t), h[own].tobytes(), node[row[own]].tobytes(), np.stack([node[moved], comp[moved]], 1).tobytes(),
                            np.stack([node[rows], size[rows]], 1).tobytes(), b""))
            yield _batch(out, PACKED)

    return run


def _looked_up(pairs: np.ndarray, v: np.ndarray, default: np.ndarray) -> np.ndarray:
    """The second member of the pair that begins with v, or the default."""
    pairs = pairs.reshape(-1, 2)
    if not len(pairs) or not len(v):
        return default
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    at = np.minimum(np.searchsorted(pairs[:, 0], v), len(pairs) - 1)
    return np.where(pairs[at, 0] == v, pairs[at, 1], default)


def lists(h: np.ndarray, v: np.ndarray, c: np.ndarray):
    """Entries of the lists that hold several components: their indices, and the length of each one's list."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    twin = np.zeros(len(hs) + 1, bool)
    twin[1:-1] = hs[1:] == hs[:-1]
    order = order[twin[1:] | twin[:-1]]  # a list of one holds one component
    order = order[np.lexsort((v[order], h[order]))]
    h, v = h[order], v[order]
    fresh = np.ones(len(h), bool)  # not a class that another task sent too
    fresh[1:] = (h[1:] != h[:-1]) | (v[1:] != v[:-1])
    order, h = order[fresh], h[fresh]
    if not len(order):
        return order, order
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    length = np.diff(np.r_[first, len(h)])
    c = c[order]
    mixed = np.repeat(np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first), length)
    return order[mixed], np.repeat(length, length)[mixed]


def _occurrences(n_tasks: int, full: bool):
    """For each set, how many of the task's lists hold another component (node, count); or, ``full``, those
    entries themselves (node, size, component, shingle, list length).  Dealt by node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, v, moved, sizes = _gathered(batches, [np.uint64, np.int64, np.int64, np.int64])
        c = _looked_up(moved, v, v)
        own, length = lists(h, v, c)
        if full:
            z = _looked_up(sizes, v[own], np.zeros(len(own), np.int64))
            arrays = [v[own], z, c[own], h[own], length.astype(np.int64)]
        else:
            arrays = list(np.unique(v[own], return_counts=True))
        yield _batch(list(_dealt((arrays[0] % n_tasks).astype(np.int32), n_tasks, arrays)), PACKED)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shared): the counts of some nodes, added up."""
    v, count = _gathered(batches, [np.int64, np.int64])
    nodes, at = np.unique(v, return_inverse=True)
    shared = np.bincount(at, weights=count, minlength=len(nodes)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(shared)], ["node", "shared"])


def _short_lists(rule: Rule, n_tasks: int):
    """The entries of sets in their short lists (shingle, node, size, place, component), dealt by shingle again.

    Shingles that no other component has come first; the others follow by list length and hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, z, c, h, length = _gathered(batches, [np.int64, np.int64, np.int64, np.uint64, np.int64])
        order = np.lexsort((h, length, v))
        v, z, c, h = v[order], z[order], c[order], h[order]
        if len(v):
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            count = np.diff(np.r_[first, len(v)])
            place = z - np.repeat(count, count) + np.arange(len(v)) - np.repeat(first, count)
            keep = place <= rule.apart(z)
            h = h[keep]
            yield _batch(list(_dealt(_by_shingle(h, n_tasks), n_tasks, [h, v[keep], z[keep], place[keep], c[keep]])), PACKED)

    return run


def merge_lists(rule: Rule, h: np.ndarray, v: np.ndarray, z: np.ndarray, at: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of different components from the lists of one task, once for each list that has both.

    h, v, z, at, c: shingle, node, size, place and component of every entry.  Sizes must allow the
    similarity, and enough shingles must be left from the shared one on in both sets.
    """
    own, _ = lists(h, v, c)
    if not len(own):
        return
    own = own[np.lexsort((v[own], z[own], h[own]))]
    h, v, z, at, c = h[own], v[own], z[own], at[own], c[own]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    length = np.diff(np.r_[first, len(h)])
    end = np.repeat(first + length, length)

    def fit(i, j):
        need = rule.overlap(z[i], z[j])
        ok = (c[i] != c[j]) & (100 * z[i] >= rule.percent * z[j]) & (z[i] - at[i] >= need) & (z[j] - at[j] >= need)
        return v[i[ok]], v[j[ok]]

    left = np.flatnonzero(np.repeat(length <= STEPPED, length))
    step = 1
    while len(left):
        left = left[left + step < end[left]]
        if len(left):
            yield fit(left, left + step)
        step += 1
    for a, m in zip(first[length > STEPPED], length[length > STEPPED], strict=True):
        last = a + np.searchsorted(z[a: a + m], 100 * z[a: a + m] // rule.percent, side="right")
        for i in range(a, a + m):
            if last[i - a] > i + 1:
                yield fit(np.full(last[i - a] - i - 1, i), np.arange(i + 1, last[i - a]))


def _merge(rule: Rule):
    """The pairs (x, y) that the task's lists give."""
    def merged(pairs):
        x, y = (np.concatenate(p) for p in zip(*pairs, strict=True))
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(y[first])], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = 0, []
        for x, y in merge_lists(rule, *_gathered(batches, [np.uint64, *[np.int64] * 4])):
            if len(x):
                waiting.append((x, y))
                held += len(x)
                if held > 1_000_000:
                    yield merged(waiting)
                    held, waiting = 0, []
        if waiting:
            yield merged(waiting)

    return run


def _probe(rule: Rule):
    """Pairs that link: the smaller set's shingles are searched in the larger one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = sorted((np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)), key=len)
                need = rule.overlap(len(a), len(b))
                if len(a) >= need:
                    ok[i] = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a) >= need
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    return run


class Join:
    """The steps of one join over ``docs``; see the module's text."""

    def __init__(self, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, tagged: bool = False):
        if not 0 < percent <= 100 or n < 1:
            raise ValueError("percent is from 1 to 100, n at least 1")
        self.rule, self.spark = Rule(n, percent), docs.sparkSession
        self.tagged = tagged
        self.texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))

    def run(self) -> DataFrame:
        full = self.members().select("_id", "n", "component_id")
        return full.unionByName(self.rows.filter(F.col("n") == 0).select("_id", "n", F.col("_id").alias("component_id")))

    def members(self) -> DataFrame:
        """The rows with shingles (_id, n, component_id); and, if tagged, their tags and the smallest (null, _id, tag) of
        their component, ``eldest``, which tells components apart whose smallest id is the same."""
        texts, schema, eldest = self.texts, PROFILE, []
        if self.tagged:
            texts, schema, eldest = texts.withColumn("tag", text_tag("text")), PROFILE + ", tag binary", ["eldest"]
        self.rows = rows = pin(texts.mapInArrow(_profile(self.rule, self.tagged), schema))
        first = [F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "tag")).alias("eldest") for _ in eldest]
        classes = rows.filter(F.col("n") > 0).groupBy("s1", "s2").agg(F.min("_id").alias("id"), *[F.min(c).alias(c) for c in ("n", "k1", "k2", "k3", "k4", "band")], *first)
        self.classes = pin(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("comp", F.col("node")))
        some, sets = self.banded()
        label = components(pin(self.linked(pin(self.star_pairs(some)), sets), SETS_PER_BATCH))
        label = pin(self.classes.join(label, "node", "left").select("node", "id", "s1", "s2", "n", "band", *eldest, F.coalesce("component", "node").alias("comp")))
        far = self.far_links(label.join(some.select("node"), "node", "left_semi"), sets)
        if not far.isEmpty():
            joined = (far.join(label.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
                      .join(label.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            upper = components(joined).select(F.col("node").alias("comp"), F.col("component").alias("top"))
            label = label.join(upper, "comp", "left").select("node", "id", "s1", "s2", *eldest, F.coalesce("top", "comp").alias("comp"))
        least = label.groupBy("comp").agg(F.min("id").alias("component_id"), *[F.min(c).alias(c) for c in eldest])
        found = label.drop(*eldest).join(least, "comp").select("s1", "s2", "component_id", *eldest)
        return rows.filter(F.col("n") > 0).join(found, ["s1", "s2"]).select("_id", "n", "component_id", *eldest, *["tag" for _ in eldest])

    def star_pairs(self, some: DataFrame) -> DataFrame:
        """Classes that agree on two min-hashes, each with the two centres of its group."""
        pairs = (("k1", "k2"), ("k3", "k4"), ("k1", "k3"), ("k2", "k4"))
        own = some.select("node", "n", "k1", "k2", "k3", "k4",
                          F.struct(((F.col("band") - F.col("shared")) / F.col("n")).alias("private"), F.col("node").alias("x"), F.col("n").alias("xn")).alias("least"),
                          F.struct(F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.col("node").alias("x"), F.col("n").alias("xn")).alias("eldest"))
        own = own.withColumn("keys", F.array(*[F.struct(F.lit(i).alias("i"), F.col(p).alias("p"), F.col(q).alias("q")) for i, (p, q) in enumerate(pairs)]))
        keys = own.select("node", "n", "least", "eldest", F.explode("keys").alias("key")).select("node", "n", "least", "eldest", "key.*")
        centre = keys.groupBy("i", "p", "q").agg(F.min("least").alias("least"), F.min("eldest").alias("eldest"), F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)
        centre = centre.select("i", "p", "q", "least.x", "least.xn").union(centre.select("i", "p", "q", "eldest.x", "eldest.xn"))
        both = keys.select("node", "n", "i", "p", "q").join(centre, ["i", "p", "q"])
        fits = 100 * F.least("n", "xn") >= self.rule.percent * F.greatest("n", "xn")
        return both.filter((F.col("x") != F.col("node")) & fits).select(F.least("x", "node").alias("x"), F.greatest("x", "node").alias("y")).distinct()

    def sets_of(self, need: DataFrame) -> DataFrame:
        """(node, words) of some classes (node, id, s1, s2), read from a member's text."""
        need = pin(need.select("node", "id", "s1", "s2"))
        ids = need.select(F.col("id").alias("_need")).distinct()
        if need.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        texts = self.texts.join(ids, F.col("_id").eqNullSafe(F.col("_need")), "left_semi")
        sets = texts.select("text").mapInArrow(_sets(self.rule, False), SETS).dropDuplicates(["s1", "s2"])
        return pin(need.join(sets, ["s1", "s2"]).select("node", "words"))

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (x, y) of classes that reach the similarity, as (a, b)."""
        both = (pairs.join(sets.select(F.col("node").alias("y"), F.col("words").alias("wy")), "y")
                .join(sets.select(F.col("node").alias("x"), F.col("words").alias("wx")), "x").select("x", "y", "wx", "wy"))
        return both.mapInArrow(_probe(self.rule), "a long, b long")

    def tasks(self, entries: int | None) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-(entries or 0) // ENTRIES_PER_TASK))

    def occurrences(self, rows: DataFrame, entries: int | None, full: bool, limit: np.uint64 | None = None) -> tuple[DataFrame, int]:
        """PACKED rows by node for rows (node, comp, n, words), and the number of tasks that they are dealt to."""
        n = self.tasks(entries)
        dealt = rows.select("node", "comp", "n", "words").mapInArrow(_entries(n, limit), PACKED).repartition(n, "task")
        return dealt.mapInArrow(_occurrences(n, full), PACKED).repartition(n, "task"), n

    def left(self, label: DataFrame, rows: DataFrame, size: str, limit: np.uint64 | None = None) -> DataFrame:
        """The classes of ``label`` that have enough shingles in common with other components, and how many (``shared``)."""
        total = label.agg(F.sum(size)).first()[0]
        shared = self.occurrences(rows, total, False, limit)[0].mapInArrow(_summed, "node long, shared long")
        most = F.col("n") - F.ceil(F.col("n") * F.lit(self.rule.percent) / F.lit(100))
        found = label.join(shared, "node", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
        return pin(found.filter(F.col(size) - F.col("shared") <= most), SETS_PER_BATCH)

    def banded(self) -> tuple[DataFrame, DataFrame]:
        """The classes that the first round leaves, and their sets (node, words)."""
        own = self.classes.filter(F.col("n") >= self.rule.smallest)
        band = self.texts.select("text").mapInArrow(_sets(self.rule, True), SETS)
        some = self.left(own, band.join(own, ["s1", "s2"]), "band")
        return some, self.sets_of(some)

    def far_links(self, some: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between different components of some classes."""
        some = self.left(some, some.join(sets, "node"), "band", self.rule.band).drop("shared")
        some = self.left(some, some.join(sets, "node"), "n").drop("shared")
        packed, n = self.occurrences(some.join(sets, "node"), some.agg(F.sum("n")).first()[0], True)
        pairs = packed.mapInArrow(_short_lists(self.rule, n), PACKED).repartition(n, "task").mapInArrow(_merge(self.rule), "x long, y long")
        pairs = pin(pairs.distinct(), SETS_PER_BATCH)
        return pin(self.linked(pairs, sets), SETS_PER_BATCH)


def near_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    out = Join(docs, n, percent, id_col, text_col).run()
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def text_tag(text) -> Column:
    """Sixteen bytes that tell texts apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", spare_null_ids: bool = True) -> DataFrame:
    """One row of each component: the one with the smallest id, then the smallest tag of its text; of equal ones any.

    Rows are told apart by id and text, so rows that share an id stand for themselves.  A null id is larger than any
    other; with ``spare_null_ids`` rows without an id all stay.
    """
    own = Join(docs, n, percent, id_col, text_col, tagged=True).members()
    if spare_null_ids:
        own = own.filter(F.col("_id").isNotNull())
    kept = F.col("_id").eqNullSafe(F.col("eldest._id")) & (F.col("tag") == F.col("eldest.tag"))
    listed = own.groupBy("_id", "tag", kept.alias("_kept")).agg(F.count(F.lit(1)).alias("m")).filter(~F.col("_kept") | (F.col("m") > 1))
    listed = pin(listed.select(F.col("_id").alias("_own_id"), F.col("tag").alias("_own_tag"), "_kept"))
    rows = docs.select(F.struct("*").alias("_twinlake_row"), F.col(id_col).cast("long").alias("_twinlake_id"), text_tag(text_col).alias("_twinlake_tag"))
    same = F.col("_twinlake_id").eqNullSafe(F.col("_own_id")) & (F.col("_twinlake_tag") == F.col("_own_tag"))
    out = rows.join(listed, same, "left_anti")
    again = listed.filter("_kept")
    if not again.isEmpty():
        out = out.unionByName(rows.join(again, same, "left_semi").dropDuplicates(["_twinlake_id", "_twinlake_tag"]))
    return out.select("_twinlake_row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), n=4, percent=85)


# Shingles as lists of words, links by shared-shingle counts, components by repeated minima.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, reach.r FROM reach JOIN both_ways b ON b.x = reach.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.r) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
