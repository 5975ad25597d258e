"""Properties and edge cases of SURVEY §5.2, on small fixtures and sf0.001 tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions import redact as G
from twinlake.operators import commands as K
from twinlake.operators import diff as D
from twinlake.operators import integrity as I
from twinlake.operators import listing as L
from twinlake.operators import merge as M
from twinlake.operators.scan import ordered_scan
from twinlake.plans import sync as S
from twinlake.sources import fixtures as fx
from twinlake.sources.tables import (ForeignKey, TablePair, TableSpec, Tables, publish_snapshot,
                                     read_snapshot, snapshot_versions)

from .conftest import SF_SMALL


def rows(df, *order):
    """Order-insensitive row list; NULLs sort first."""
    return sorted((tuple(r) for r in df.collect()),
                  key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF_SMALL)


# --- sync ------------------------------------------------------------------
def test_sync_all_makes_read_equal_write_and_second_sync_is_noop(spark, t, tmp_root):
    pairs = [TablePair(TableSpec("orders", keys=("o_orderkey",)), fx.replica_write(t), fx.replica_read(t)),
             TablePair(TableSpec("lineitem"), t.lineitem, t.lineitem.limit(5))]
    report, versions = S.sync_all(spark, pairs, tmp_root)
    state = {r["table_name"]: (r["n_rows"], r["is_equal"]) for r in S.sync_state(spark, pairs, tmp_root, versions).collect()}
    assert state["orders"] == (t.orders.count(), True)
    assert state["lineitem"] == (t.lineitem.count(), True)
    acts = {r["action"] for r in report.filter("table_name = 'orders'").collect()}
    assert acts <= {"insert", "update", "delete", "same", "next_key"} and "update" in acts
    # second sync over the published replica: every row is 'same'
    again = [TablePair(TableSpec("orders", keys=("o_orderkey",)), fx.replica_write(t),
                       read_snapshot(spark, tmp_root, "orders"))]
    rep2, _ = S.sync_all(spark, again, tmp_root)
    diff_actions = {r["action"] for r in rep2.collect()} & {"insert", "update", "delete", "same"}
    assert diff_actions == {"same"}
    assert snapshot_versions(spark, tmp_root, "orders") == [0, 1]


def test_sync_all_cleans_fk_orphans_after_load(spark, t, tmp_root):
    fk = ForeignKey("fk", ("o_custkey",), "customer", ("c_custkey",))
    pairs = [TablePair(TableSpec("customer", keys=("c_custkey",)), t.customer, t.customer.limit(0)),
             TablePair(TableSpec("orders", keys=("o_orderkey",), fks=(fk,)), fx.fk_child(t), fx.fk_child(t).limit(0))]
    report, versions = S.sync_all(spark, pairs, tmp_root)
    child = read_snapshot(spark, tmp_root, "orders")
    assert I.fk_orphans(child, t.customer, fk).count() == 0
    removed = [r["n_rows"] for r in report.collect() if r["action"] == "fk_removed"]
    assert removed == [I.fk_orphans(fx.fk_child(t), t.customer, fk).count()]
    # null FK rows survive
    assert child.filter("o_custkey IS NULL").count() == fx.fk_child(t).filter("o_custkey IS NULL").count()


def test_upsert_is_idempotent(t):
    w, r = fx.replica_write(t), fx.replica_read(t)
    once = M.upsert(r, w, ["o_orderkey"])
    twice = M.upsert(once, w, ["o_orderkey"])
    assert rows(once) == rows(twice)


def test_empty_write_empties_read(t):
    w = fx.replica_write(t).limit(0)
    assert M.delete_orphans(fx.replica_read(t), w, ["o_orderkey"]).count() == 0


def test_all_key_table_insert_if_absent(spark):
    read = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    write = spark.createDataFrame([(1, 2), (2, 2)], "a int, b int")
    assert rows(M.insert_if_absent(read, write, ["a", "b"])) == [(1, 1), (1, 2), (2, 2)]


def test_composite_orphans(t):
    o = D.orphans(fx.composite_read(t), fx.composite_write(t), ["author_id", "book_id"])
    assert o.filter(F.col("book_id") < 1_000_000).count() == 0


def test_null_unique_values_never_clash(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "k int, u string")
    v = I.unique_violations(df, ["u"]).collect()
    assert [(r["u"], r["n_rows"]) for r in v] == [("x", 2)]


def test_conflict_holder_many_holders_no_pairs(spark):
    w = spark.createDataFrame([(1, "a"), (2, "b")], "k int, u string")
    r = spark.createDataFrame([(5, "a"), (6, "a"), (7, "a"), (2, "b")], "k int, u string")
    out = rows(M.conflict_holders(w, r, ["k"], ["u"]))
    assert out == [(1, "a", 5, 3)]


def test_fk_chain_is_fixpoint(t):
    fk1 = ForeignKey("a", ("o_custkey",), "customer", ("c_custkey",))
    fk2 = ForeignKey("b", ("l_orderkey",), "orders", ("o_orderkey",))
    tables = {"customer": t.customer, "orders": fx.fk_child(t), "lineitem": fx.fk_grandchild(t)}
    out = I.fk_cleanup_chain(tables, {"orders": [fk1], "lineitem": [fk2]})
    again = I.fk_cleanup_chain(out, {"orders": [fk1], "lineitem": [fk2]})
    assert out["lineitem"].count() == again["lineitem"].count()
    assert I.fk_orphans(out["lineitem"], out["orders"], fk2).count() == 0


def test_self_referencing_fk_reaches_fixpoint(spark):
    emp = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (5, 4)], "id int, boss int")
    fk = ForeignKey("boss", ("boss",), "emp", ("id",))
    out = I.fk_cleanup_chain({"emp": emp}, {"emp": [fk]})
    assert rows(out["emp"]) == [(1, None), (2, 1), (3, 2)]


def test_not_null_gate_raises_with_counts(t):
    with pytest.raises(I.NotNullViolation):
        I.not_null_gate(fx.fk_child(t), ["o_custkey"])
    assert I.not_null_gate(t.orders, ["o_orderkey"]) == {"o_orderkey": 0}


def test_snapshot_publish_never_overwrites(spark, tmp_root):
    df = spark.range(3)
    assert publish_snapshot(df, tmp_root, "x") == 0
    cur = read_snapshot(spark, tmp_root, "x")
    assert publish_snapshot(cur.filter("id > 0"), tmp_root, "x") == 1
    assert read_snapshot(spark, tmp_root, "x").count() == 2
    assert read_snapshot(spark, tmp_root, "x", 0).count() == 3


def test_publish_skips_version_left_by_failed_write(spark, tmp_root):
    import os
    publish_snapshot(spark.range(2), tmp_root, "y")
    os.makedirs(f"{tmp_root}/y/v=1")  # a write that died before committing
    assert snapshot_versions(spark, tmp_root, "y") == [0]
    assert publish_snapshot(spark.range(5), tmp_root, "y") == 2
    assert read_snapshot(spark, tmp_root, "y").count() == 5


def test_rebuild_on_key_type_change(t):
    drifted = fx.replica_read(t).withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    table, rebuilt = M.rebuild_on_key_type_change(drifted, fx.replica_write(t), ["o_orderkey"])
    assert rebuilt and rows(table) == rows(t.orders)
    same, rebuilt2 = M.rebuild_on_key_type_change(fx.replica_read(t), fx.replica_write(t), ["o_orderkey"])
    assert not rebuilt2


def test_cdc_apply_equals_full_resync(t):
    from twinlake.plans.queries import _change_log
    out = M.apply_changes(fx.replica_read(t), _change_log(t), ["o_orderkey"])
    assert rows(out) == rows(t.orders)


# --- listing ---------------------------------------------------------------
def test_pages_concatenate_to_full_listing(t):
    df = L.filter_eq(t.orders, {"o_orderstatus": "O"})
    total = df.count()
    seen = []
    for p in range(1, L.total_pages(total, 7) + 1):
        seen += [r["o_orderkey"] for r in L.page(df, L.PageRequest(p, 7), "o_orderdate", "o_orderkey").collect()]
    full = [r["o_orderkey"] for r in L.newest_first(df, "o_orderdate", "o_orderkey").collect()]
    assert seen == full and len(set(seen)) == total


def test_total_pages_edges(t):
    empty = t.orders.filter("o_orderstatus = 'X'")
    m = L.page_meta(empty, L.PageRequest(1, 10)).first()
    assert (m["total"], m["total_pages"]) == (0, 0)
    assert L.total_pages(20, 10) == 2 and L.total_pages(21, 10) == 3


@pytest.mark.parametrize("page,limit", [(0, 10), (1, 0), (1, 101), ("2", 10)])
def test_page_bounds_checked_before_planning(page, limit):
    with pytest.raises(ValueError):
        L.PageRequest(page, limit)


def test_absent_filter_differs_from_null(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "k int, v string")
    assert L.filter_eq(df, {"v": L.ABSENT}).count() == 2
    assert rows(L.filter_eq(df, {"v": None})) == [(1, None)]


# --- commands --------------------------------------------------------------
CMD_SCHEMA = "event_id long, ts timestamp_ntz, id long, op string, has_value boolean, has_props boolean, value double, props string"


def _cmds(spark, data):
    from datetime import datetime, timedelta
    base = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + timedelta(seconds=i), *r) for i, r in enumerate(data)], CMD_SCHEMA)


def test_fold_edge_cases(spark):
    c = _cmds(spark, [
        (1, "update", True, False, 1.0, None),   # 404: not live
        (1, "create", True, True, 2.0, "p"),     # 200
        (1, "create", True, True, 9.0, "q"),     # 400: live, fields untouched
        (1, "update", False, False, None, None), # 200, no fields: updated_at unchanged
        (1, "update", True, False, None, None),  # 200, explicit null clears value, props kept
        (1, "delete", False, False, None, None), # 200, returns deleted row
        (1, "get", False, False, None, None),    # 404
        (1, "create", False, True, None, "r"),   # 200, recreate: absent value -> NULL
    ])
    f = K.fold(c).orderBy("event_id").collect()
    assert [r["code"] for r in f] == [404, 200, 400, 200, 200, 200, 404, 200]
    assert (f[2]["value"], f[2]["props"]) == (2.0, "p")
    assert f[3]["updated_at"] == f[1]["ts"]
    assert (f[4]["value"], f[4]["props"], f[4]["updated_at"]) == (None, "p", f[4]["ts"])
    assert f[5]["props"] == "p" and not f[5]["live_after"]
    assert (f[7]["value"], f[7]["props"], f[7]["created_at"]) == (None, "r", f[7]["ts"])
    st = K.current_state(K.fold(c)).collect()
    assert len(st) == 1 and st[0]["props"] == "r"


def test_skew_safe_scan_equals_plain_window_on_hot_key(spark, t):
    # a third of all commands re-keyed onto one entity
    c = fx.commands(t).withColumn("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")))
    a = K.fold(c, skew_safe=True)
    b = K.fold(c, skew_safe=False)
    assert rows(a) == rows(b)


def test_ordered_scan_sums(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(50)] + [(2, 0, 5)], "k int, o int, v int")
    out = ordered_scan(df, ["k"], ["o"], sums={"run": F.col("v")}, inclusive=True, segments=7)
    got = {(r["k"], r["o"]): r["run"] for r in out.collect()}
    assert got[(1, 49)] == sum(range(50)) and got[(1, 10)] == sum(range(11)) and got[(2, 0)] == 5


def test_duplicate_assign_in_one_batch(spark):
    from datetime import datetime
    ts = datetime(2024, 1, 1)
    cmds = spark.createDataFrame([(1, 1, ts, 1, 1), (1, 1, ts, 1, 2), (1, 2, ts, 2, 1), (3, 1, ts, 3, 1)],
                                 "author_id long, book_id long, ts timestamp_ntz, l_orderkey long, l_linenumber int")
    authors = spark.createDataFrame([(1,)], "id long")
    books = spark.createDataFrame([(1,)], "id long")
    out = K.assign(cmds, authors, books, ["ts", "l_orderkey", "l_linenumber"])
    codes = sorted((r["l_orderkey"], r["l_linenumber"], r["code"]) for r in out.collect())
    assert codes == [(1, 1, 200), (1, 2, 409), (2, 1, 404), (3, 1, 404)]
    msg = {r["l_orderkey"]: r["message"] for r in out.collect() if r["code"] == 404}
    assert msg[2] == "Book with ID 2 not found." and msg[3] == "Author with ID 3 not found."


def test_dedupe_keeps_one_copy(t, spark):
    ev = K.domain_events(K.fold(fx.commands(t)))
    doubled = ev.unionByName(ev.filter("event_type = 'author.created'"))
    assert K.dedupe_events(doubled).count() == ev.count()


# --- redaction -------------------------------------------------------------
def test_redaction_leaves_no_secret(t):
    from pyspark.sql.types import _parse_datatype_string
    from twinlake.plans.queries import LOG_SCHEMA
    logs = fx.log_records(t)
    out = logs.select(G.redact_json(F.col("record"), _parse_datatype_string(LOG_SCHEMA)).alias("r"))
    bad = out.filter(F.col("r").rlike(r'"pw[0-9]|"tk[0-9]|"img[0-9]|"b64[0-9]|"deep[0-9]|Bearer '))
    assert bad.count() == 0
    assert out.filter(F.col("r").contains('"image":"keep')).count() == logs.count()


def test_level_filter_unknown_threshold_means_log(t):
    logs = fx.log_records(t)
    assert G.level_filter(logs, "level", "nonsense").count() == G.level_filter(logs, "level", "log").count()


# --- drift -----------------------------------------------------------------
def test_align_strict_cast_fails_on_bad_value(spark):
    from twinlake.operators import drift as C
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    target = T.StructType([T.StructField("a", T.IntegerType())])
    assert rows(C.align(df, target, strict=False)) == [(None,), (1,)]
    with pytest.raises(Exception):
        C.align(df, target, strict=True).collect()


def test_entity_aggregate_mapping_round_trips(spark):
    df = spark.createDataFrame([("u1", "Ann", "Lee", None)], "id string, first_name string, last_name string, birth_date date")
    agg = K.to_aggregate(df, K.AUTHOR_COLUMNS)
    assert agg.columns == ["id", "firstName", "lastName", "birthDate"]
    assert K.to_entity(agg, K.AUTHOR_COLUMNS).columns == df.columns


def test_sync_aligns_drifted_schema_and_reports(spark, t, tmp_root):
    read = fx.drift_read(t)  # no o_orderpriority, extra legacy_flag, o_totalprice as text
    pair = TablePair(TableSpec("orders", keys=("o_orderkey",)), t.orders, read)
    report, versions = S.sync_all(spark, [pair], tmp_root)
    got = {r["action"]: r["n_rows"] for r in report.collect()}
    assert got["column_add"] == 1 and got["column_drop"] == 1 and got["column_retype"] == 1
    assert got["next_key"] == t.orders.agg(F.max("o_orderkey")).first()[0] + 1
    assert rows(read_snapshot(spark, tmp_root, "orders")) == rows(t.orders)


def test_sync_rebuilds_on_key_type_change(spark, t, tmp_root):
    read = t.orders.withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    pair = TablePair(TableSpec("orders", keys=("o_orderkey",)), t.orders, read)
    report, _ = S.sync_all(spark, [pair], tmp_root)
    assert "rebuild" in {r["action"] for r in report.collect()}
    assert rows(read_snapshot(spark, tmp_root, "orders")) == rows(t.orders)


def test_json_topic_records_keep_absent_vs_null(spark, t, tmp_root):
    from twinlake.streaming import topics, twins
    cmd = fx.commands(t)
    topics.write_records(twins.command_records(cmd), f"{tmp_root}/topic", chunks=2)
    src = topics.file_stream(spark, f"{tmp_root}/topic")
    fields = {"value": "double", "props": "string"}
    q = (topics.parse_commands(src, "author", fields).writeStream.format("memory").queryName("parsed_cmds")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("parsed_cmds")
    want = cmd.select("event_id", "ts", "id", "op", "has_value", "has_props",
                      F.when(F.col("has_value"), F.col("value")).alias("value"),
                      F.when(F.col("has_props"), F.col("props")).alias("props"))
    assert rows(got.select(*want.columns)) == rows(want)


def test_name_set_diff(spark):
    a = spark.createDataFrame([("x",), ("y",)], "n string")
    b = spark.createDataFrame([("y",), ("z",)], "n string")
    assert rows(D.name_set_diff(a, b, "n")) == [("x", "create"), ("z", "drop")]


def test_small_helpers(spark):
    from twinlake.functions import scalar
    from twinlake.functions import validate as V
    from twinlake.operators import aggregates as A
    df = spark.createDataFrame([(1, "a", "550e8400-e29b-41d4-a716-446655440000", 5),
                                (2, "b", "nope", 150)], "k int, s string, u string, n int")
    assert A.non_empty(df) and not A.non_empty(df.filter("k > 9"))                      # A5
    probe = spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(A.exists_in(df, probe, ["k"])) == [(1, True), (3, False)]               # A8
    r = df.select(scalar.composite_key_json(F.col("k"), F.col("s")).alias("j"),         # F7
                  scalar.yes_no(F.col("k") == 1).alias("yn"),                           # F11
                  V.is_uuid(F.col("u"), "id").alias("uuid"),                            # V1
                  *V.in_range(F.col("n"), 1, 100, "limit")).orderBy("j").collect()      # V7
    assert [x["j"] for x in r] == ['["1","a"]', '["2","b"]']
    assert [x["yn"] for x in r] == ["YES", "NO"]
    assert [x["uuid"] for x in r] == [None, "id must be a UUID"]
    assert r[1][3:] == (None, "limit must not be greater than 100")


def test_sync_guards_duplicate_keys(spark, t, tmp_root):
    dup_read = fx.replica_read(t).unionByName(fx.replica_read(t).limit(3))
    res = S.sync_table(TablePair(TableSpec("orders", keys=("o_orderkey",)), t.orders, dup_read))
    assert {r["action"] for r in res.report.collect()} == {"replace_duplicate_keys"}
    assert rows(res.new_read) == rows(t.orders)
    with pytest.raises(S.KeyViolation):
        S.sync_table(TablePair(TableSpec("orders", keys=("o_orderkey",)), dup_read, t.orders))


def test_transform_with_state_twin_equals_batch(spark, t):
    from twinlake.streaming import twins
    cmd = fx.commands(t)
    out = twins.applied_run(spark, cmd, api="transform_with_state")
    batch = K.fold(cmd).select("event_id", "id", "code", "value", "props", "created_at", "updated_at")
    assert rows(out.select(*batch.columns)) == rows(batch)


def test_pointer_jumping_equals_fixpoint_loop(spark):
    import random
    rnd = random.Random(7)
    n = 300
    rows_ = []
    for i in range(n):
        r = rnd.random()
        boss = None if r < 0.05 else (n + 5 if r < 0.08 else rnd.randrange(max(i, 1)) if r < 0.9 else rnd.randrange(n))
        rows_.append((i, boss))
    # a long dangling chain and a cycle
    rows_ += [(1000 + k, 1000 + k - 1) for k in range(1, 40)] + [(1000, 99999)]
    rows_ += [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2002)]
    emp = spark.createDataFrame(rows_, "id int, boss int")
    fk = ForeignKey("boss", ("boss",), "emp", ("id",))
    loop = I.fk_cleanup_chain({"emp": emp}, {"emp": [fk]})["emp"]
    jump = I.fk_cleanup_chain({"emp": emp}, {"emp": [fk]}, keys={"emp": "id"})["emp"]
    assert rows(jump) == rows(loop)
    kept = {r[0] for r in jump.collect()}
    assert {2000, 2001, 2002, 2003} <= kept and not any(1000 <= k < 1040 for k in kept)


def test_upsert_with_fallback(spark):
    read = spark.createDataFrame([(1, "a"), (2, "b")], "k int, u string")
    ok_write = spark.createDataFrame([(2, "c"), (3, "d")], "k int, u string")
    new, mode = M.upsert_with_fallback(read, ok_write, ["k"], ["u"])
    assert mode == "upsert" and rows(new) == [(1, "a"), (2, "c"), (3, "d")]
    clash = spark.createDataFrame([(3, "a")], "k int, u string")      # 'a' still held by key 1
    new, mode = M.upsert_with_fallback(read, clash, ["k"], ["u"])
    assert mode == "replaced" and rows(new) == [(3, "a")]


def test_library_helpers(spark, t, tmp_root):
    from twinlake.functions import scalar
    from twinlake.operators import relations as R
    from twinlake.sources.tables import list_snapshot_tables
    # D3: write labels missing from read, write order kept
    df = spark.createDataFrame([(["a", "b", "c"], ["b"])], "w array<string>, r array<string>")
    assert df.select(D.label_set_diff(F.col("w"), F.col("r"))).first()[0] == ["a", "c"]
    # J1 nested reply shape for a bounded set of entities (two suppliers)
    long = R.m2n_expand(t.supplier.filter("s_suppkey <= 2"), fx.m2n_link(t), t.part,
                        "s_suppkey", "author_id", "book_id", "p_partkey")
    nested = R.m2n_nested(long, ["s_suppkey"], ["p_partkey", "p_name"], "books", "p_partkey").collect()
    n_links = fx.m2n_link(t).filter("author_id <= 2").count()
    assert sum(len(r["books"]) for r in nested) == n_links
    assert all(r["books"] == sorted(r["books"]) for r in nested)
    # F10, F16, F17
    x = spark.createDataFrame([(["x", "y"], [1, 2], [3], "2024-02-03", "1.5", "zz")],
                              "m array<string>, a array<int>, b array<int>, d string, n string, bad string")
    r = x.select(scalar.join_messages(F.col("m")), scalar.same_length(F.col("a"), F.col("a")),
                 scalar.same_length(F.col("a"), F.col("b")), scalar.coerce_date(F.col("d")).isNotNull(),
                 scalar.coerce_number(F.col("n")), scalar.coerce_number(F.col("bad"))).first()
    assert tuple(r) == ("x; y", True, False, True, 1.5, None)
    # K14 maps for the other two entities
    link = spark.createDataFrame([("l1", "a1", "b1", None)], "id string, author_id string, book_id string, assigned_at timestamp")
    assert K.to_aggregate(link, K.LINK_COLUMNS).columns == ["id", "authorId", "bookId", "assignedAt"]
    book = spark.createDataFrame([("b1", "T", None, 1999)], "id string, title string, isbn string, published_year int")
    assert K.to_aggregate(book, K.BOOK_COLUMNS).columns == ["id", "title", "isbn", "publishedYear"]
    # snapshot root listing: only tables with a committed version
    publish_snapshot(spark.range(1), tmp_root, "t1")
    import os
    os.makedirs(f"{tmp_root}/t2/v=0")
    assert list_snapshot_tables(spark, tmp_root) == ["t1"]


def test_timeout_boundary_and_inbound_decode_edges(spark):
    from datetime import datetime, timedelta
    from twinlake.functions import envelope as E
    from twinlake.streaming.replies import correlate
    t0 = datetime(2024, 1, 1)
    req = spark.createDataFrame([(1, t0), (2, t0), (3, t0)], "event_id long, ts timestamp_ntz")
    rep = spark.createDataFrame([(1, t0 + timedelta(seconds=10)), (2, t0 + timedelta(seconds=10, milliseconds=1))],
                                "event_id long, rts timestamp_ntz")
    got = {r["event_id"]: (r["code"], r["latency_ms"]) for r in correlate(req, rep, 10).collect()}
    assert got == {1: (200, 10000), 2: (503, None), 3: (503, None)}
    texts = ['{"success":false,"error":{"code":0,"message":""},"statusCode":409,"message":"m"}',
             '{"success":false,"error":{"code":"E1"}}',
             '{"data":{"a":1}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [tuple(r[0]) for r in df.select(E.decode_inbound(F.col("t"))).collect()]
    assert out[0] == (False, 409, "m", None)                     # 0 and '' fall through (JS ||)
    assert out[1] == (False, 400, "Internal server error", None)  # text code -> 400, default message
    assert out[2] == (True, None, None, '{"a":1}')                # no success flag: treated as success


def test_redaction_walks_arrays_and_maps(spark):
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(
        "image string, items array<struct<name: string, token: string, image: string>>, "
        "headers map<string,string>")
    rec = ('{"image":"top","items":[{"name":"a","token":"t1","image":"keep"},{"name":"b","token":"t2"}],'
           '"headers":{"password":"pw","host":"h"}}')
    out = spark.createDataFrame([(rec,)], "r string").select(G.redact_json(F.col("r"), schema)).first()[0]
    assert "t1" not in out and "t2" not in out and '"pw"' not in out and '"top"' not in out
    assert '"image":"keep"' in out and '"host":"h"' in out


def test_conflict_holders_composite_key(spark):
    w = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k1 int, k2 int, u string")
    r = spark.createDataFrame([(9, 9, "a"), (1, 2, "b")], "k1 int, k2 int, u string")
    out = [(tuple(x["write_key"]), x["u"], tuple(x["read_key"]), x["n_holders"])
           for x in M.conflict_holders(w, r, ["k1", "k2"], ["u"]).collect()]
    assert out == [((1, 1), "a", (9, 9), 1)]
