"""The unique index beside a bucketed replica: batches judged as a whole, only touched values looked at."""

import random

import pytest

from twinlake.sources.buckets import BucketedTable
from twinlake.sources.unique_index import UniqueClash, UniqueReplica

ROW = "id long, u string, w long"
CHANGE = "id long, seq long, op string, row struct<id:long,u:string,w:long>"


def replica(spark, root, rows, unique=("u",)):
    r = UniqueReplica(BucketedTable(root, "t", ("id",), 4), unique)
    r.create(spark.createDataFrame(rows, ROW))
    return r


def batch(spark, rows):
    return spark.createDataFrame([(i, s, "upsert" if v is not None else "delete", (i, *v) if v is not None else None) for i, s, v in rows], CHANGE)


def judged(state, marks, changes):
    """The batch by a loop: accepted changes and refused keys, refusals repeated until there are no new ones."""
    last = {}
    for i, s, v in sorted(changes, key=lambda c: c[1]):
        last[i] = (s, v)
    last = {i: c for i, c in last.items() if c[0] > marks.get(i, -1)}
    refused = set()
    while True:
        claims = {}
        for i in {*state, *last}:
            mine, new = state.get(i), last[i][1] if i in last else state.get(i)
            stays = i not in last or i in refused or (mine or (None,))[0] == (new or (None,))[0]
            value = (mine if stays else new) or (None,)
            if value[0] is not None:
                claims.setdefault(value[0], []).append((0 if stays else 1, last[i][0] if i in last and not stays else -1, i))
        more = {i for held in claims.values() for rank, _, i in held if rank == 1 and (rank, _, i) != min(held)}
        if more <= refused:
            break
        refused |= more
    for i, (s, v) in last.items():
        if i not in refused:
            marks[i] = s
            if v is None:
                state.pop(i, None)
            else:
                state[i] = v
    return refused


def rows(r, spark):
    return {x["id"]: (x["u"], x["w"]) for x in r.table.read(spark).collect()}


def index(r, spark):
    return {x["value"]: x["holder"]["id"] for x in r.index.read(spark).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_a_loop(spark, tmp_root, seed):
    rng = random.Random(seed)
    state, marks = {i: (f"v{i}", i) for i in range(12)}, {}
    r = replica(spark, tmp_root, [(i, *v) for i, v in state.items()])
    seq = 0
    for _ in range(3):
        changes = []
        for _ in range(12):
            seq += 1
            changes.append((rng.randint(0, 14), max(0, seq - rng.choice([0, 0, 9])) * 10 + seq % 10, rng.choice([None, (None, 1), *[(f"v{rng.randint(0, 15)}", seq)] * 5])))
        want = judged(state, marks, changes)
        _, refused = r.apply(batch(spark, changes))
        assert {x["id"] for x in refused.collect()} == want
        assert rows(r, spark) == state
        assert sorted(index(r, spark).values()) == sorted(i for i, v in state.items() if v[0] is not None)


def test_swaps_pass_and_holders_keep(spark, tmp_root):
    r = replica(spark, tmp_root, [(1, "a", 0), (2, "b", 0), (3, "c", 0)])
    _, refused = r.apply(batch(spark, [(1, 1, ("b", 1)), (2, 2, ("a", 1)), (4, 3, ("c", 1)), (5, 4, ("new", 1)), (6, 5, ("new", 1))]))
    assert {(x["id"], x["holder"]["id"]) for x in refused.collect()} == {(4, 3), (6, 5)}
    assert rows(r, spark) == {1: ("b", 1), 2: ("a", 1), 3: ("c", 0), 5: ("new", 1)}


def test_a_writer_that_stops_between_the_commits(spark, tmp_root, monkeypatch):
    r = replica(spark, tmp_root, [(1, "a", 0), (2, "b", 0)])
    with monkeypatch.context() as m:
        m.setattr(UniqueReplica, "_mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            r.apply(batch(spark, [(1, 1, ("z", 1))]))
    assert not r.current(spark)
    _, refused = r.apply(batch(spark, [(2, 2, ("z", 1)), (3, 3, ("a", 1))]))
    assert r.current(spark) and {x["id"] for x in refused.collect()} == {2}
    assert rows(r, spark) == {1: ("z", 1), 2: ("b", 0), 3: ("a", 1)}


def test_nulls_composite_values_and_a_broken_start(spark, tmp_root):
    r = replica(spark, tmp_root, [(1, "a", 1), (2, "a", 2), (3, None, 1), (4, None, 1)], ("u", "w"))
    _, refused = r.apply(batch(spark, [(5, 1, ("a", 2)), (6, 2, (None, 1)), (7, 3, ("a", 3))]))
    assert {x["id"] for x in refused.collect()} == {5}
    with pytest.raises(UniqueClash):
        replica(spark, f"{tmp_root}/other", [(1, "a", 0), (2, "a", 1)])
    done, refused = r.apply(batch(spark, []))
    assert done.version is None and refused.count() == 0
