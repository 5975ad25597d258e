"""The table-set sync: one commit, counts observed by the write jobs, untouched tables kept."""

import pytest
from pyspark.sql import functions as F

from twinlake.plans import table_set as TS
from twinlake.sources.tables import ForeignKey, TableSpec, snapshot_versions


def put(spark, root, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{root}/{name}.parquet")


A, B = "id long, b_id long, v string", "id long, a_id long"
SPECS = {
    "a": TableSpec("a", keys=("id",), uniques=(("v",),), not_null=("id",), lengths={"v": 5}, fks=(ForeignKey("a_b", ("b_id",), "b", ("id",)),)),
    "b": TableSpec("b", keys=("id",), fks=(ForeignKey("b_a", ("a_id",), "a", ("id",)),)),
    "pairs": TableSpec("pairs", keys=("x", "y")),
}


@pytest.fixture()
def roots(spark, tmp_root):
    w, r = f"{tmp_root}/write", f"{tmp_root}/read"
    # a and b refer to each other: 3 -> missing b 9, then b 4 -> a 3 dangles, then a 4 -> b 4
    put(spark, w, "a", [(1, 1, "one"), (2, None, "two"), (3, 9, "three"), (4, 4, None)], A)
    put(spark, w, "b", [(1, 1), (4, 3)], B)
    put(spark, w, "pairs", [(1, 1), (1, 1), (2, None)], "x long, y long")
    put(spark, w, "log", [(1, "x"), (1, "x")], "n long, t string")
    put(spark, w, "migrations", [(1,)], "id long")
    return w, r


def report(df):
    return {(r["table_name"], r["action"]): r["n_rows"] for r in df.collect()}


def rows(spark, r, name, version=None):
    return sorted((tuple(x) for x in TS.read_table(spark, r, name, version).collect()), key=repr)


def test_first_sync_creates_and_cleans_a_mutual_reference(spark, roots):
    w, r = roots
    got = report(TS.sync_table_set(spark, w, r, SPECS))
    assert got == {("a", "create"): 4, ("b", "create"): 2, ("pairs", "create"): 2, ("log", "create"): 2, ("a", "fk_removed"): 2, ("b", "fk_removed"): 1}
    assert rows(spark, r, "a") == [(1, 1, "one"), (2, None, "two")] and rows(spark, r, "b") == [(1, 1)]
    assert rows(spark, r, "log") == [(1, "x"), (1, "x")] and "migrations" not in TS.manifest(spark, r)


def test_second_sync_keeps_unchanged_tables_and_drops_obsolete_ones(spark, roots):
    w, r = roots
    TS.sync_table_set(spark, w, r, {})
    first = TS.manifest(spark, r)
    TS.sync_table_set(spark, w, r, {"pairs": SPECS["pairs"]})
    put(spark, w, "b", [(1, 1), (4, 3), (5, None)], B)
    spec = {n: TableSpec(n, keys=("id",)) for n in "ab"} | {"pairs": SPECS["pairs"]}
    TS.sync_table_set(spark, w, r, spec)
    before = TS.manifest(spark, r)
    put(spark, w, "b", [(1, 2), (5, None), (6, 1)], B)
    got = report(TS.sync_table_set(spark, w, r, spec, exclude=("migrations", "log")))
    assert got[("a", "unchanged")] == 4 and got[("pairs", "unchanged")] == 2
    assert got[("b", "insert")] == 1 and got[("b", "update")] == 1 and got[("b", "delete")] == 1 and got[("b", "same")] == 1
    after = TS.manifest(spark, r)
    assert after["a"] == before["a"] and after["pairs"] == before["pairs"] and after["b"] > before["b"] and "log" in first
    # the write side loses a table
    from twinlake.sources.tables import _fs
    fs, p = _fs(spark, f"{w}/pairs.parquet")
    fs.delete(p, True)
    assert report(TS.sync_table_set(spark, w, r, spec))[("pairs", "drop")] == 0
    assert "pairs" not in TS.manifest(spark, r)


def test_nothing_is_visible_before_the_manifest(spark, roots, monkeypatch):
    w, r = roots
    TS.sync_table_set(spark, w, r, SPECS)
    old = TS.manifest(spark, r), rows(spark, r, "a")
    put(spark, w, "a", [(1, 1, "new")], A)
    with monkeypatch.context() as m:
        m.setattr(TS, "publish_set", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            TS.sync_table_set(spark, w, r, SPECS)
    assert (TS.manifest(spark, r), rows(spark, r, "a")) == old
    assert TS.vacuum(spark, r) > 0 and rows(spark, r, "a") == old[1]
    TS.sync_table_set(spark, w, r, SPECS)
    assert rows(spark, r, "a") == [(1, 1, "new")]
    TS.vacuum(spark, r, keep=1)
    assert snapshot_versions(spark, r, "a") == [TS.manifest(spark, r)["a"]]


@pytest.mark.parametrize("bad", [[(1, 1, "one"), (2, None, "one")], [(1, 1, "too long")], [(1, 1, "x"), (1, 1, "y")], [(None, 1, "x")]])
def test_a_broken_write_side_commits_nothing(spark, roots, bad):
    w, r = roots
    TS.sync_table_set(spark, w, r, SPECS)
    versions = TS.set_versions(spark, r)
    put(spark, w, "a", bad, A)
    with pytest.raises(ValueError):
        TS.sync_table_set(spark, w, r, SPECS)
    assert TS.set_versions(spark, r) == versions and len(rows(spark, r, "a")) == 2


def test_columns_and_labels(spark, roots):
    w, r = roots
    spec = {"b": TableSpec("b", keys=("id",))}
    TS.sync_table_set(spark, w, r, spec)
    put(spark, w, "b", [("1", "x"), ("7", "y")], "id string, kind string")
    got = report(TS.sync_table_set(spark, w, r, spec, enums={"b": ("kind",)}))  # a key of another type: the table is rebuilt
    assert got[("b", "rebuild")] == 2 and got[("b", "column_drop")] == 1 and got[("b", "column_add")] == 1
    put(spark, w, "b", [("1", "x"), ("7", "z")], "id string, kind string")
    got = report(TS.sync_table_set(spark, w, r, spec, enums={"b": ("kind",)}))
    assert got[("b", "enum_add")] == 1 and got[("b", "enum_drop")] == 1 and got[("b", "update")] == 1
    assert TS.read_table(spark, r, "b").filter(F.col("kind") == "z").count() == 1
