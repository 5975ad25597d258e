"""The bidiagonal qd solver and the whitening of vectors, against numpy's decompositions."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from twinlake.llm import whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
EPS = np.finfo(float).eps


def triangles():
    rng = np.random.default_rng(4)
    for d in (1, 2, 3, 17, 64):
        yield f"random {d}", np.triu(rng.standard_normal((d, d)))
    yield "identity", np.eye(7) * 3
    x = rng.standard_normal((100, 20))
    x[:, 5], x[:, 7] = 0, x[:, 3]
    yield "constant and repeated columns", np.linalg.qr(x, mode="r")
    for grades in (np.logspace(0, -12, 20), np.logspace(-12, 0, 20)):
        yield "graded", np.linalg.qr(rng.standard_normal((100, 20)) * grades, mode="r")
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    yield "equal values", np.linalg.qr(np.diag(np.r_[np.full(10, 5.0), np.full(10, 5 + 1e-12), np.linspace(1, 2, 10)]) @ turn, mode="r")
    w = np.diag(np.abs(np.arange(41) - 20.0) + 3) + np.diag(np.ones(40), 1) + np.diag(np.ones(40), -1)
    yield "close pairs", np.linalg.cholesky(w).T


@pytest.mark.parametrize("name,r", list(triangles()), ids=lambda v: v if isinstance(v, str) else "")
def test_directions(name, r):
    s, v = whitening.directions(r, len(r))
    want = np.linalg.svd(r, compute_uv=False)
    want = want[want > len(r) * EPS * want[0]]
    assert len(s) == len(want) and np.abs(s - want).max() < 1e-13 * want[0]
    assert np.abs(v.T @ v - np.eye(len(s))).max() < 1e-11
    assert np.abs(r.T @ (r @ v) - v * s ** 2).max() < 1e-13 * want[0] ** 2


def test_dqds_keeps_the_digits_of_small_values():
    a, b = np.logspace(0, -60, 13), np.logspace(-1, -61, 12)
    got = np.sqrt(whitening.dqds(a, b))
    prod = math.prod(a)  # the determinant is the product of the singular values
    assert math.prod(got) == pytest.approx(prod, rel=1e-12) and (got > 0).all()


def test_no_variance():
    s, v = whitening.directions(np.zeros((4, 4)), 4)
    assert len(s) == 0 and v.shape == (4, 0)


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def reference(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:k]
    return n, ((n * x - s) ** 2).sum(axis=1), y @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(8)
    good = (rng.standard_normal((400, 12)) * np.linspace(3, 0.3, 12)).astype(np.float32)
    good[100:230] = good[7]  # a third of the rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    odd = [(None, None), (900, None), (901, []), (902, [1.0]), (903, [math.nan] + [0.0] * 11), (904, [math.inf] * 12), (905, [None] * 12), (906, [0.0] * 13)]
    df = table(spark, rows + odd).selectExpr("*", "1 AS n", "'x' AS key", "2 AS deviation", "3 AS whitened")
    w = whitening.fit(df, components=8)
    n, deviation, z, explained = reference(good, 8)
    got = {r["vec_id"]: r for r in whitening.project(df, w).collect()}
    assert set(got) == set(range(400)) and w.centre.n == n
    assert [got[i]["deviation"] for i in range(400)] == deviation.tolist()
    own = np.array([got[i]["whitened"] for i in range(400)])
    assert np.abs(own * np.sign((own * z).sum(axis=0)) - z).max() < 1e-9
    assert np.abs(np.array(w.explained) - explained).max() < 1e-12
    assert whitening.identity_error(df, w) < 1e-10


def test_merging_many_parts_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE_BYTES", 1)  # two at a time
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4)).astype(np.float32) * 9
    w = whitening.fit(table(spark, [(i, v.tolist()) for i, v in enumerate(x)], 23))
    _, _, _, explained = reference(x, 4)
    assert np.abs(np.array(w.explained) - explained).max() < 1e-12


def test_query_on_repeated_rows_null_ids_and_small_tables(spark, tmp_path):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [3.0, -1.0]), (1, [0.0, 0.0])]
    for name, data, count in (("some", rows, 8), ("equal", [(1, [1.0, 2.0])] * 3, 0), ("one", rows[:1], 0), ("none", [], 0), ("null", [(1, None)], 0)):
        table(spark, data, 1).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        out = whitening.op12(spark, str(tmp_path / name)).collect()
        assert len(out) == count, name
        assert all(r["n"] == len(data) and r["identity_error"] < 1e-10 for r in out)


def test_long_distances_stay_exact(spark):
    rows = [(0, [2.0 ** 40, 1.0]), (1, [-2.0 ** 40, 0.0]), (2, [0.0, 0.5])]
    w = whitening.fit(table(spark, rows, 1))
    got = {r["vec_id"]: r["deviation"] for r in whitening.project(table(spark, rows, 1), w).collect()}
    x = [[int(math.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert [got[i] for i in range(3)] == [v if v < 1 << 63 else None for v in want] and got[0] is None and got[2] is not None
