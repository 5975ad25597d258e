"""The bucketed replica: only touched buckets are read and written, one commit, any order of batches."""

import random

import pytest
from pyspark.sql import functions as F

from twinlake.sources import buckets
from twinlake.sources.buckets import BucketedTable

ROW = "struct<id:bigint,part:string,v:string,fk:bigint>"
CHANGES = f"id bigint, part string, seq bigint, op string, row {ROW}"


def change(key, seq, value=None, fk=None):
    return (*key, seq, "delete", None) if value is None else (*key, seq, "upsert", (*key, value, fk))


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


def new_table(spark, root, rows, n=8):
    table = BucketedTable(root, "t", ("id", "part"), n)
    table.create(spark.createDataFrame(rows, ROW[7:-1].replace(":", " ")))
    return table


def state(table, spark, version=None):
    return {(r["id"], r["part"]): (r["v"], r["fk"]) for r in table.read(spark, version).collect()}


START = [(i, "a" if i % 2 else None, f"v{i}", i % 5) for i in range(40)]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_root):
    table = new_table(spark, tmp_root, START, 16)
    before = table.manifest(spark)[1]
    done = table.apply(changes(spark, [change((1, "a"), 1, "new"), change((500, "b"), 1, "x"), change((2, None), 1)]))
    after = table.manifest(spark)[1]
    assert 1 <= len(done.buckets) <= 3
    assert {b for b in after if after[b] != before.get(b)} == set(done.buckets)
    got = state(table, spark)
    assert got[1, "a"] == ("new", None) and got[500, "b"] == ("x", None) and (2, None) not in got and len(got) == 40
    assert state(table, spark, 0) == {(i, p): (v, f) for i, p, v, f in START}  # the older version still stands


def test_one_shuffle_and_no_file_of_other_buckets(spark, tmp_root, monkeypatch):
    table = new_table(spark, tmp_root, START, 16)
    seen = {}
    write = BucketedTable._write
    monkeypatch.setattr(BucketedTable, "_write", lambda self, rows: seen.update(rows=rows) or write(self, rows))
    sets = table.manifest(spark)[1]
    done = table.apply(changes(spark, [change((1, "a"), 1, "new")]))
    assert len(done.buckets) == 1
    files = [f for f in seen["rows"].inputFiles() if "/data/w=" in f]
    assert files and all(sets[done.buckets[0]] in f for f in files)
    plan = seen["rows"]._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_and_twice_equal_one_fold(spark, tmp_root, seed):
    rng = random.Random(seed)
    log = [change((rng.randint(0, 12), rng.choice(["a", None])), s, rng.choice([None, f"s{s}", f"s{s}"]), s % 4) for s in range(60)]
    want = {(i, p): (v, f) for i, p, v, f in START}
    for i, p, s, op, row in log:
        want.pop((i, p), None)
        if op == "upsert":
            want[i, p] = row[2:]
    rng.shuffle(log)
    table = new_table(spark, tmp_root, START, 4)
    for k in range(0, 60, 20):
        table.apply(changes(spark, log[k: k + 20]))
    table.apply(changes(spark, log[5:30]))  # delivered again
    assert state(table, spark) == want


def test_a_write_that_stops_before_its_manifest_changes_nothing(spark, tmp_root, monkeypatch):
    table = new_table(spark, tmp_root, START, 4)
    before, versions = state(table, spark), table.versions(spark)

    def stop(*a):
        raise RuntimeError("lost")

    batch = changes(spark, [change((1, "a"), 7, "late"), change((3, "a"), 7)])
    with monkeypatch.context() as m:
        m.setattr(buckets, "publish_snapshot", stop)
        with pytest.raises(RuntimeError):
            table.apply(batch)
    assert state(table, spark) == before and table.versions(spark) == versions
    left = table.vacuum(spark)  # the files of the failed write
    assert left >= 1
    table.apply(batch)
    got = state(table, spark)
    assert got[1, "a"] == ("late", None) and (3, "a") not in got and len(got) == len(before) - 1


def test_marks_of_deleted_keys_hold_until_forgotten(spark, tmp_root):
    table = new_table(spark, tmp_root, START, 2)
    table.apply(changes(spark, [change((1, "a"), 10)]))
    table.apply(changes(spark, [change((1, "a"), 9, "too late")]))
    assert (1, "a") not in state(table, spark)
    table.apply(changes(spark, [change((1, "a"), 8, "older")]), forget_below=11)
    table.apply(changes(spark, [change((1, "a"), 5, "forgotten, so it is new")]))
    assert state(table, spark)[1, "a"] == ("forgotten, so it is new", None)


def test_empty_batches_and_empty_tables(spark, tmp_root):
    table = new_table(spark, tmp_root, [], 4)
    assert state(table, spark) == {}
    assert table.apply(changes(spark, [])) == buckets.Applied(None, ()) and table.versions(spark) == [0]
    table.apply(changes(spark, [change((None, None), 1, "null key"), change((None, None), 2, "again")]))
    assert state(table, spark) == {(None, None): ("again", None)}
    table.apply(changes(spark, [change((None, None), 3)]))
    assert state(table, spark) == {}


def test_incremental_sync_of_rows_and_children(spark, tmp_root):
    table = new_table(spark, tmp_root, START, 4)
    write = spark.createDataFrame([(i, "a" if i % 2 else None, f"w{i}", i % 5) for i in range(0, 60, 3)], ROW[7:-1].replace(":", " "))
    ids = spark.createDataFrame([(3, "a"), (3, "a"), (1, "a"), (57, "a")], "id bigint, part string")
    done, missing = table.sync_rows(ids, write, seq=1)
    assert [tuple(r) for r in missing.collect()] == [(1, "a")]
    got = state(table, spark)
    assert got[3, "a"] == ("w3", 3) and got[57, "a"] == ("w57", 2) and got[1, "a"] == ("v1", 1)
    table.delete_rows(ids, seq=2)
    assert not {(3, "a"), (1, "a"), (57, "a")} & set(state(table, spark))
    table.sync_children(spark.createDataFrame([(2,), (4,)], "id bigint"), write.filter("id % 2 = 1"), "fk", "id", seq=3)
    got = {k: v for k, v in state(table, spark).items() if v[1] in (2, 4)}
    assert got == {(i, "a"): (f"w{i}", i % 5) for i in range(3, 60, 6) if i % 5 in (2, 4)}


def test_vacuum_keeps_what_the_newest_versions_name(spark, tmp_root):
    table = new_table(spark, tmp_root, START, 4)
    for s in range(1, 5):
        table.apply(changes(spark, [change((s, "z"), s, f"v{s}")]))
    want = state(table, spark)
    assert table.vacuum(spark, keep=1) > 0
    assert state(table, spark) == want and table.versions(spark) == [4]
    table.apply(changes(spark, [change((9, "z"), 9, "on")]))
    assert len(state(table, spark)) == len(want) + 1
