"""Whitening of embeddings with a bidiagonal qd solver.

1. Sums.  Tasks turn entries c into integers x = floor(64 c) + 1000000 and add them up exactly.
2. Blockwise QR.  Tasks centre their rows and reduce them, batch by batch, to one upper triangular R; a tree of
   merges (QR of stacked Rs) leaves the R of all rows.  No product of the data with itself is ever formed, so the
   singular values of R keep the digits that a covariance matrix would lose.
3. On the driver, from one d x d matrix: Householder reflections make R bidiagonal; dqds (differential quotient
   difference with shifts) finds its singular values to high relative accuracy; for each of the largest, a twisted
   factorisation of B'B - s*s*I gives the direction.
4. Tasks project the centred rows on the directions.  The covariance of the projections, merged by a tree from
   block moments that are centred before multiplying, is compared with the identity.

What leaves a task is one d x d (or k x k) matrix, merged by a tree of bounded fan-in; the driver sees one.

Results in special cases
* Dropped: null vectors, vectors with null or non-finite entries, entries beyond ``LIMIT``, empty vectors, and
  vectors whose length is not the one that most of the others have (the smaller of two as frequent).
* Null ids and repeated rows: rows like others.  A row counts as often as it occurs.
* Directions without variance (singular values below d * eps of the largest) are no components: fewer than
  ``COMPONENTS`` rows a vector; none where all vectors are equal.  Empty table: empty result.
* Equal eigenvalues: some orthonormal basis of their space.  Sign: the entry of largest size is positive.
* ``deviation`` is exact; null where it exceeds a long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import pin

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this size have no place in a 64-bit x.
LIMIT = 2.0 ** 55
#: Bytes of matrices that one merge holds.
MERGE_BYTES = 64 << 20
EPS = np.finfo(float).eps


# -- the solver: R -> singular values and right singular directions -----------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a and superdiagonal b of B, and V, with r = U B V'; by Householder reflections from both sides."""
    r, d = r.copy(), r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        u, norm = x.copy(), float(np.linalg.norm(x))
        if norm == 0 or len(x) == 1:
            return u, 0.0
        u[0] += math.copysign(norm, u[0])
        return u, 2.0 / float(u @ u)

    for k in range(d):
        u, t = reflector(r[k:, k])
        r[k:, k:] -= t * np.outer(u, u @ r[k:, k:])
        if k < d - 2:
            u, t = reflector(r[k, k + 1:])
            r[k:, k + 1:] -= t * np.outer(r[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= t * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def dqds(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Squares of the singular values of the bidiagonal (a, b), largest first.

    One sweep maps the squares (q, e) to those of a bidiagonal whose squared singular values are smaller by the
    shift; only positive terms are added, so nothing cancels.  A shift is valid where all pivots stay positive; one
    that is not is made smaller, zero at last."""
    tol2, found = (10 * EPS) ** 2, []
    work = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while work:
        q, e, sigma = work.pop()
        shift = 0.0
        while q:
            if len(q) == 1 or e[-1] <= tol2 * (sigma + q[-1]):
                found.append(sigma + q.pop())
                if e:
                    e.pop()
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tol2 * sigma or e[i] < 1e-290), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:
                q.reverse()
                e.reverse()
            # the smaller root of the last two rows bounds the least eigenvalue from above; Johnson's bound from below
            p, w, o = q[-2] + e[-1], q[-1], q[-1] * e[-1]
            above = 2 * (p * w - o) / (p + w + math.sqrt((p - w) ** 2 + 4 * o))
            roots = [0.0, *map(math.sqrt, e), 0.0]
            below = max(0.0, min(math.sqrt(x) - (roots[i] + roots[i + 1]) / 2 for i, x in enumerate(q))) ** 2
            shift = max(below * (1 - 8 * EPS), above * (1 - 8 * EPS) if e[-1] < 0.1 * q[-1] else 0.5 * above)
            for attempt in range(60):
                nq, ne, piv, last = [], [], q[0] - shift, True
                for i in range(len(e)):
                    if piv < 0:
                        last = False
                        break
                    s = piv + e[i]
                    ratio = q[i + 1] / s if s > 0 else 0.0
                    nq.append(s)
                    ne.append(e[i] * ratio)
                    piv = piv * ratio - shift
                if last and piv >= 0:
                    break
                # failed at the last pivot only: what it lacks says how much too large the shift was
                lower = (shift + piv) * (1 - 4 * EPS) if last else 0.25 * shift
                shift = 0.0 if attempt > 50 else max(lower, below) if lower > 0 and below < shift else below if below < shift else 0.25 * shift
            q, e, sigma = [*nq, piv], ne, sigma + shift
    return sorted(found, reverse=True)


def _twisted(dd: np.ndarray, ll: np.ndarray, lam: float) -> np.ndarray:
    """The direction of L D L' - lam I for an eigenvalue lam: stationary factorisation from the top, progressive one
    from the bottom, joined at the twist where the residual is least."""
    n, tiny = len(dd), np.finfo(float).tiny * 1e16
    s, lp = np.empty(n), np.empty(n - 1)
    s[0] = -lam
    for i in range(n - 1):
        pivot = s[i] + dd[i] or tiny
        lp[i] = dd[i] * ll[i] / pivot
        s[i + 1] = lp[i] * ll[i] * s[i] - lam
    p, um = np.empty(n), np.empty(n - 1)
    p[-1] = dd[-1] - lam
    for i in range(n - 2, -1, -1):
        pivot = dd[i] * ll[i] ** 2 + p[i + 1] or tiny
        t = dd[i] / pivot
        um[i] = ll[i] * t
        p[i] = p[i + 1] * t - lam
    # residual of the twist at k: s_k + p_k + lam where both factorisations are finite
    gamma = np.where(np.isfinite(s) & np.isfinite(p), np.abs(s + p + lam), np.inf)
    k = int(np.argmin(gamma))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lp[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -um[i] * z[i]
        if not np.isfinite(z[i + 1]):
            z[i + 1:] = 0
            break
    z[~np.isfinite(z)] = 0
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for y in earlier:
            z = z - (y @ z) * y
    return z


def directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of r (without those that are zero to rounding) and, as columns, their right
    singular directions."""
    d, scale = r.shape[1], float(np.abs(r).max()) if r.size else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((d, 0))
    a, b, v = bidiagonal(r / scale)
    small = EPS * max(float(np.abs(a).max()), float(np.abs(b).max()) if d > 1 else 0.0)
    a = np.where(np.abs(a) < 1e-150, 1e-150, a)
    cuts = [0, *(np.flatnonzero(np.abs(b) <= small) + 1).tolist(), d]
    values = []  # (square, block)
    for lo, hi in zip(cuts, cuts[1:]):
        values += [(x, lo, hi) for x in dqds(a[lo:hi], b[lo: hi - 1])]
    values.sort(key=lambda t: (-t[0], t[1]))
    values = [t for t in values[:k] if math.sqrt(max(t[0], 0.0)) > d * EPS * math.sqrt(values[0][0])]
    out, by_block = [], {}
    rng = np.random.default_rng(12)
    for lam, lo, hi in values:
        if hi - lo == 1:
            z = np.ones(1)
        else:
            dd, ll = a[lo:hi] ** 2, b[lo: hi - 1] / a[lo: hi - 1]
            z = _twisted(dd, ll, lam)
            near = [y for other, y in by_block.get(lo, []) if abs(other - lam) <= 1e-3 * values[0][0]]
            z = _apart(z, near)
            if np.linalg.norm(z) < 0.5:  # a cluster: inverse iteration away from its earlier members
                t = np.diag(a[lo:hi]) + np.diag(b[lo: hi - 1], 1)
                t = t.T @ t - lam * (1 + 2 * EPS) * np.eye(hi - lo)
                z = rng.standard_normal(hi - lo)
                for _ in range(4):
                    z = _apart(z, near)
                    z = np.linalg.solve(t + EPS * values[0][0] * np.eye(hi - lo), z / np.linalg.norm(z))
                z = _apart(z, near)
            z = z / np.linalg.norm(z)
            by_block.setdefault(lo, []).append((lam, z))
        full = np.zeros(d)
        full[lo:hi] = z
        full = v @ full
        out.append(full * math.copysign(1.0, full[np.argmax(np.abs(full))]))
    return np.array([math.sqrt(t[0]) * scale for t in values]), np.array(out).T.reshape(d, len(out))


# -- vectors of a batch ------------------------------------------------------------

def _usable(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, x) of a batch's usable vectors, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        c = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
        good = (np.abs(c) < LIMIT).all(axis=1)  # false for null (NaN), NaN and infinite
        if good.any():
            yield int(d), at[good], np.floor(c[good] * SCALE).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list] = {}
    for batch in batches:
        for d, at, x in _usable(batch.column(0)):
            own = totals.setdefault(d, [0, [0] * d])
            own[0] += len(at)
            exact = x if int(np.abs(x).max()) < (1 << 62) // len(at) else x.astype(object)
            own[1] = [s + int(t) for s, t in zip(own[1], exact.sum(axis=0).tolist(), strict=True)]
    names = ["length", "n", "sums"]
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t[0] for t in totals.values()], pa.int64()),
                                      pa.array([[Decimal(s) for s in t[1]] for t in totals.values()], pa.list_(pa.decimal128(38, 0)))], names=names)


@dataclass
class Centre:
    """Exact mean of the fit list: n vectors of d entries; the mean is base + rest / n."""

    n: int
    d: int
    base: np.ndarray
    rest: np.ndarray

    def of(self, batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, integer distances from ``base`` and centred rows of a batch's vectors."""
        for d, at, x in _usable(batch_column):
            if d == self.d:
                x = x - self.base
                return at, x, x - self.rest / self.n
        return np.zeros(0, int), np.zeros((0, self.d), np.int64), np.zeros((0, self.d))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 = (n (x - base) - rest)^2, in whole numbers."""
        if not len(x):
            return []
        most = self.n * (int(np.abs(x).max()) + 1)
        if self.d * most * most < 1 << 63:
            y = self.n * x - self.rest
            return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - self.rest.astype(object)
        return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]


def centre(vectors: DataFrame, vector: str) -> Centre | None:
    parts = pin(vectors.select(vector).mapInArrow(_sums, "length int, n long, sums array<decimal(38,0)>"))
    best = parts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "length").first()  # one row
    if best is None:
        return None
    rows = (parts.filter(F.col("length") == best["length"]).select(F.posexplode("sums").alias("p", "s"))
            .groupBy("p").agg(F.sum("s").alias("s")).orderBy("p").collect())  # a row for each dimension
    n, sums = int(best["n"]), [int(r["s"]) for r in rows]
    return Centre(n, int(best["length"]), np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


# -- merging matrices by a tree --------------------------------------------------

def _merged(parts: DataFrame, size: int, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """The merge of all (id, payload) rows, ``fan`` at a time; ids are task numbers."""
    fan, schema = max(2, min(32, MERGE_BYTES // (8 * size))), "id long, payload array<double>"

    def step(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        done = merge([np.array(p) for p in table["payload"].to_pylist()])
        return pa.table({"id": pa.array([table["id"][0].as_py() // fan], pa.int64()), "payload": pa.array([done.tolist()], pa.list_(pa.float64()))})

    parts = pin(parts)
    while True:
        most = parts.agg(F.max("id")).first()[0]
        if most is None:
            return None
        if most == 0:
            return np.array(parts.first()["payload"])
        parts = pin(parts.groupBy(F.floor(F.col("id") / fan).alias("g")).applyInArrow(step, schema))


def _one(payload: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if payload is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([payload.tolist()], pa.list_(pa.float64()))], names=["id", "payload"])


def triangle(vectors: DataFrame, vector: str, at: Centre) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    d = at.d

    def square(r: np.ndarray) -> np.ndarray:
        return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            _, _, y = at.of(batch.column(0))
            if len(y):
                r = square(np.linalg.qr(y if r is None else np.vstack([r, y]), mode="r"))
        yield from _one(None if r is None else r.ravel())

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        return square(np.linalg.qr(np.vstack([p.reshape(d, d) for p in parts]), mode="r")).ravel()

    return _merged(vectors.select(vector).mapInArrow(reduce, "id long, payload array<double>"), d * d, merge).reshape(d, d)


def _moments(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Count, means and centred products of the union of blocks (pairwise update)."""
    n, mean, prod = 0.0, np.zeros(k), np.zeros((k, k))
    for p in parts:
        m, own = p[0], p[1: k + 1]
        gap, both = own - mean, n + m
        prod = prod + p[k + 1:].reshape(k, k) + np.outer(gap, gap) * (n * m / both)
        mean, n = mean + gap * (m / both), both
    return np.concatenate([[n], mean, prod.ravel()])


# -- the operator ------------------------------------------------------------------

@dataclass
class Whitening:
    """A fitted whitening: mean, directions (columns, divided by the standard deviation), eigenvalues and the trace."""

    centre: Centre | None
    matrix: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.eigenvalues / self.trace).tolist() if self.trace else []


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    at = centre(vectors, vector)
    if at is None:
        return Whitening(None, np.zeros((0, 0)), np.zeros(0), 0.0)
    r = triangle(vectors, vector, at)
    values, ways = directions(r, components)
    e = values * values / at.n
    return Whitening(at, ways / np.sqrt(e), e, float((r * r).sum()) / at.n)


def project(vectors: DataFrame, w: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation, whitened): one row for each vector of the fit list, its whitened components in an array."""
    at, matrix, kind = w.centre, w.matrix, vectors.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x, y = at.of(batch.column(1)) if at is not None else (np.zeros(0, int), None, None)
            if len(places):
                z = y @ matrix
                offsets = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(at.deviations(x), pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))], names=["key", "deviation", "whitened"])

    return vectors.select(key, vector).mapInArrow(step, f"key {kind}, deviation long, whitened array<double>").withColumnRenamed("key", key)


def identity_error(vectors: DataFrame, w: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    at, matrix = w.centre, w.matrix
    k = matrix.shape[1]
    if at is None or not k:
        return 0.0

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, _, y = at.of(batch.column(0))
            if len(y):
                z = y @ matrix
                mean = z.mean(axis=0)
                block = np.concatenate([[float(len(z))], mean, ((z - mean).T @ (z - mean)).ravel()])
                total = block if total is None else _moments([total, block], k)
        yield from _one(total)

    total = _merged(vectors.select(vector).mapInArrow(reduce, "id long, payload array<double>"), k * k + k + 1, lambda parts: _moments(parts, k))
    return float(np.abs(total[k + 1:].reshape(k, k) / total[0] - np.eye(k)).max())


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    w = fit(vectors)
    error, n = identity_error(vectors, w), w.centre.n if w.centre else 0
    rows = project(vectors, w).select("vec_id", "deviation", F.posexplode("whitened").alias("p", "whitened"))
    explained = F.array(*[F.lit(x) for x in w.explained]).cast("array<double>")
    return rows.select("vec_id", (F.col("p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("p")).alias("explained"), F.lit(error).alias("identity_error"))
