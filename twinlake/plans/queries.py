"""Registered query plans: one function per key, each ``(spark, sf_dir) -> DataFrame``.

Every plan reads the driver tables (directly or through a fixture Spark derives
from them) and runs over all of their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import listing
from ..sources import fixtures as fx
from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


LIST_PAGE = listing.PageRequest(page=3, limit=10)
LIST_FILTER = {"o_orderstatus": "F"}


# --- FX-LIST ---------------------------------------------------------------
@query
def scan_full(spark, sf):
    return fx.listing(Tables(spark, sf))


@query
def scan_keys(spark, sf):
    return fx.listing(Tables(spark, sf)).select("o_orderkey")


@query
def list_filter_eq(spark, sf):
    return listing.filter_eq(fx.listing(Tables(spark, sf)),
                             {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": listing.ABSENT})


@query
def list_filter_none(spark, sf):
    return listing.filter_eq(fx.listing(Tables(spark, sf)),
                             {"o_orderstatus": listing.ABSENT, "o_orderpriority": listing.ABSENT})


@query
def list_newest_first(spark, sf):
    return listing.newest_first(fx.listing(Tables(spark, sf)), "o_orderdate", "o_orderkey")


@query
def list_page(spark, sf):
    df = listing.filter_eq(fx.listing(Tables(spark, sf)), LIST_FILTER)
    return listing.page(df, LIST_PAGE, "o_orderdate", "o_orderkey")


@query
def list_deep_page(spark, sf):
    """L2: the page of ten that follows the middle of all orders, found by counts over ranges."""
    o = fx.listing(Tables(spark, sf))
    middle = o.count() // 2 // LIST_PAGE.limit + 1
    return listing.deep_page(o, listing.PageRequest(page=middle, limit=LIST_PAGE.limit), "o_orderdate", "o_orderkey", small=100)


@query
def list_page_meta(spark, sf):
    df = listing.filter_eq(fx.listing(Tables(spark, sf)), LIST_FILTER)
    return listing.page_meta(df, LIST_PAGE)


@query
def list_page_with_meta(spark, sf):
    df = listing.filter_eq(fx.listing(Tables(spark, sf)), LIST_FILTER)
    return listing.page_with_meta(df, LIST_PAGE, "o_orderdate", "o_orderkey")


@query
def lookup_by_id(spark, sf):
    return listing.lookup_by_id(fx.listing(Tables(spark, sf)), "o_orderkey", 4242)


@query
def lookup_many_with_status(spark, sf):
    t = Tables(spark, sf)
    ids = fx.replica_read(t).select("o_orderkey")
    return listing.lookup_many(ids, fx.listing(t), "o_orderkey", "o_orderkey")


@query
def key_high_water_mark(spark, sf):
    hwm = listing.high_water_mark(fx.listing(Tables(spark, sf)), "o_orderkey", start=1)
    return hwm.select(F.lit("orders").alias("table_name"), "*")


@query
def fn_iso_timestamp(spark, sf):
    o = fx.listing(Tables(spark, sf))
    return o.select("o_orderkey", scalar.iso_timestamp(F.col("o_orderdate")).alias("created_iso"))


@query
def array_membership(spark, sf):
    o = fx.listing(Tables(spark, sf))
    wanted = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return o.filter(listing.member_of(F.col("o_orderpriority"), wanted)).select("o_orderkey", "o_orderpriority")


# --- S3 inventory ----------------------------------------------------------
INVENTORY_EXCLUDE = ("migrations", "pages", "benchmark")


@query
def table_inventory(spark, sf):
    from ..sources.inventory import table_inventory as inv
    return inv(Tables(spark, sf), exclude=INVENTORY_EXCLUDE)


# --- FX-M2N ----------------------------------------------------------------
def _m2n_long(t: Tables, left_side: bool):
    from ..operators import relations as R
    link = fx.m2n_link(t)
    if left_side:
        return R.m2n_expand(fx.m2n_left(t), link, fx.m2n_right(t), "s_suppkey", "author_id", "book_id", "p_partkey")
    return R.m2n_expand(fx.m2n_right(t), link, fx.m2n_left(t), "p_partkey", "book_id", "author_id", "s_suppkey")


def _dec_sum(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query
def m2n_expand_left(spark, sf):
    """Each supplier with its related parts: count and exact price sum per entity."""
    long = _m2n_long(Tables(spark, sf), True)
    return long.groupBy("s_suppkey", "s_name").agg(
        F.count("p_partkey").alias("n_related"), _dec_sum("p_retailprice").alias("sum_related"))


@query
def m2n_expand_right(spark, sf):
    long = _m2n_long(Tables(spark, sf), False)
    return long.groupBy("p_partkey", "p_name").agg(
        F.count("s_suppkey").alias("n_related"), _dec_sum("s_acctbal").alias("sum_related"))


@query
def m2n_nested_page(spark, sf):
    """The reply shape of a listing page: ten suppliers by name, each with its related parts nested in order of id."""
    from ..operators import relations as R
    t = Tables(spark, sf)
    page = listing.page(fx.m2n_left(t).select("s_suppkey", "s_name", "s_acctbal"), listing.PageRequest(2, 10), "s_acctbal", "s_suppkey")
    long = R.m2n_expand(page, fx.m2n_link(t), fx.m2n_right(t), "s_suppkey", "author_id", "book_id", "p_partkey")
    nested = R.m2n_nested(long, ["s_suppkey", "s_name"], ["p_partkey", "p_name"], "books", "p_partkey")
    return nested.select("s_suppkey", "s_name", F.transform("books", lambda b: F.concat_ws(":", b["p_partkey"], b["p_name"])).alias("books"))


@query
def m2n_expand_rows(spark, sf):
    """J1 long form itself: one row per (supplier, related part), empty relations kept."""
    long = _m2n_long(Tables(spark, sf), True)
    return long.select("s_suppkey", "s_name", "p_partkey", "p_name")


@query
def multi_key_join(spark, sf):
    from ..operators import relations as R
    t = Tables(spark, sf)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    ab = fx.m2n_link(t)
    j = R.multi_key_join(li, ab, [("l_suppkey", "author_id"), ("l_partkey", "book_id")])
    return j.select("l_orderkey", "l_linenumber", "author_id", "book_id", "assigned_at")


def _cascade_deleted():
    """Parents deleted in the cascade fixture."""
    return F.col("s_suppkey") % 7 == 0


@query
def cascade_delete(spark, sf):
    from ..operators import merge as M
    t = Tables(spark, sf)
    deleted = fx.m2n_left(t).filter(_cascade_deleted())
    return M.cascade_delete(fx.m2n_link(t), deleted, "author_id", "s_suppkey")


@query
def sync_children(spark, sf):
    """M9: refresh the links of the suppliers in nation 0..4 from write to read."""
    from ..operators import merge as M
    t = Tables(spark, sf)
    parents = t.supplier.filter(F.col("s_nationkey") < 5)
    return M.sync_children(fx.composite_read(t), fx.composite_write(t), parents, "author_id", "s_suppkey")


# --- FX-REPLICA ------------------------------------------------------------
OKEY = ["o_orderkey"]


@query
def row_diff(spark, sf):
    from ..operators import diff as D
    t = Tables(spark, sf)
    return D.row_diff(fx.replica_write(t), fx.replica_read(t), OKEY)


@query
def row_diff_pruned(spark, sf):
    """D1 on stored tables whose bucket digests show which buckets differ: a replica one day behind its source."""
    from ..session import ensure_checkpoint_dir, scratch_path
    from ..sources import digests
    from ..sources.buckets import BucketedTable
    ensure_checkpoint_dir(spark)
    write, read = fx.day_behind(Tables(spark, sf))
    root = scratch_path(spark, f"row-diff-pruned-{uuid.uuid4().hex}")
    stored = [digests.DigestedTable(BucketedTable(root, name, tuple(OKEY), 64)) for name in ("orders_write", "orders_read")]
    for side, rows in zip(stored, (write, read), strict=True):
        side.table.create(rows)
    return digests.pruned_row_diff(spark, *stored)


@query
def upsert_by_key(spark, sf):
    from ..operators import merge as M
    t = Tables(spark, sf)
    return M.upsert(fx.replica_read(t), fx.replica_write(t), OKEY)


@query
def insert_if_absent(spark, sf):
    from ..operators import merge as M
    t = Tables(spark, sf)
    return M.insert_if_absent(fx.replica_read(t), fx.replica_write(t), OKEY)


@query
def delete_orphans(spark, sf):
    from ..operators import merge as M
    t = Tables(spark, sf)
    return M.delete_orphans(fx.replica_read(t), fx.replica_write(t), OKEY)


@query
def orphans_single_key(spark, sf):
    from ..operators import diff as D
    t = Tables(spark, sf)
    return D.orphans(fx.replica_read(t), fx.replica_write(t), OKEY)


def _requested_ids(t: Tables):
    """Ids named by 1-URGENT rows on either side (some only in read, some only in write)."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return fx.replica_read(t).filter(urgent).select(*OKEY).unionByName(
        fx.replica_write(t).filter(urgent).select(*OKEY))


@query
def sync_rows_by_id(spark, sf):
    from ..operators import merge as M
    t = Tables(spark, sf)
    new, _missing = M.sync_rows(fx.replica_read(t), fx.replica_write(t), _requested_ids(t), OKEY)
    return new


@query
def sync_rows_missing(spark, sf):
    """M8 side output: requested ids absent from write (warned and skipped)."""
    from ..operators import merge as M
    t = Tables(spark, sf)
    _new, missing = M.sync_rows(fx.replica_read(t), fx.replica_write(t), _requested_ids(t), OKEY)
    return missing


@query
def delete_rows_by_id(spark, sf):
    from ..operators import merge as M
    t = Tables(spark, sf)
    ids = fx.replica_write(t).filter(F.col("o_orderstatus") == "P").select(*OKEY)
    return M.delete_by_id(fx.replica_read(t), ids, OKEY)


def _change_log(t: Tables):
    """Change log whose fold turns read into write: the replicated (old) rows as
    seq-1 upserts, every write row as a seq-2 upsert, read orphans as seq-2 deletes."""
    w, r = fx.replica_write(t), fx.replica_read(t)
    row = F.struct(*[F.col(c) for c in w.columns])
    old = r.select(*OKEY, F.lit(1).alias("seq"), F.lit("upsert").alias("op"), row.alias("row"))
    new = w.select(*OKEY, F.lit(2).alias("seq"), F.lit("upsert").alias("op"), row.alias("row"))
    dels = r.join(w.select(*OKEY), OKEY, "left_anti").select(
        *OKEY, F.lit(2).alias("seq"), F.lit("delete").alias("op"), row.alias("row"))
    return old.unionByName(new).unionByName(dels)


@query
def cdc_apply(spark, sf):
    from ..operators import merge as M
    t = Tables(spark, sf)
    return M.apply_changes(fx.replica_read(t), _change_log(t), OKEY)


def _sync_pairs(t: Tables):
    from ..sources.tables import TablePair, TableSpec
    return [
        TablePair(TableSpec("orders", keys=("o_orderkey",)), fx.replica_write(t), fx.replica_read(t)),
        TablePair(TableSpec("authors_books", keys=("author_id", "book_id")),
                  fx.composite_write(t).select("author_id", "book_id"),
                  fx.composite_read(t).select("author_id", "book_id")),
        TablePair(TableSpec("lineitem"), t.lineitem,
                  t.lineitem.filter(F.col("l_returnflag") == "R")),
    ]


@query
def sync_report(spark, sf):
    from . import sync as S
    t = Tables(spark, sf)
    parts = [S.sync_table(p).report for p in _sync_pairs(t)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def sync_all(spark, sf):
    """M12 end to end: publish new read snapshots under the shared checkpoint dir,
    then report rows per table and equality with write."""
    import uuid
    from . import sync as S
    from ..session import scratch_path
    t = Tables(spark, sf)
    root = scratch_path(spark, f"sync_all-{uuid.uuid4().hex}")
    pairs = _sync_pairs(t)
    _report, versions = S.sync_all(spark, pairs, root)
    return S.sync_state(spark, pairs, root, versions)


def _set_specs():
    from ..sources.tables import ForeignKey, TableSpec
    one = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
           "orders": "o_orderkey", "events": "event_id"}
    fks = {"nation": [("n_regionkey", "region")], "region": [("r_regionkey", "nation")], "part": [("p_size", "nation")],
           "events": [("user_id", "supplier")], "lineitem": [("l_partkey", "part"), ("l_orderkey", "orders")]}
    return {n: TableSpec(n, keys=(one[n],) if n in one else (), not_null=(one[n],) if n in one else (), lengths={"p_name": 200} if n == "part" else {},
                         uniques=(("n_name",),) if n == "nation" else (),
                         fks=tuple(ForeignKey(f"fk_{n}_{c}", (c,), p, (one[p],)) for c, p in fks.get(n, ())))
            for n in [*one, "lineitem"]}


@query
def sync_table_set(spark, sf):
    """M12, S3, S9 as one commit: tables to create, drop and align, rows to change, references to clean (two tables refer to each other)."""
    import uuid
    from . import table_set as TS
    from ..session import scratch_path
    from ..sources.tables import publish_snapshot
    t = Tables(spark, sf)
    root = scratch_path(spark, f"table-set-{uuid.uuid4().hex}")
    old = {"orders": fx.replica_read(t).filter(F.col("o_orderpriority") != "1-URGENT"), "region": t.region, "legacy_region": t.region,
           "nation": t.nation.drop("n_regionkey"), "part": t.part.withColumn("p_size", F.col("p_size").cast("string")), "supplier": t.supplier,
           "lineitem": t.lineitem.filter(F.col("l_returnflag") == "R"), "events": t.events.filter(F.col("event_id") % 10 != 3)}
    TS.publish_set(spark, root, {n: publish_snapshot(df, root, n) for n, df in old.items()})
    other = ("migrations", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    return TS.sync_table_set(spark, sf, root, _set_specs(), exclude=other, enums={"orders": ("o_orderpriority",)})


@query
def snapshot_equal(spark, sf):
    from ..operators import diff as D
    from ..operators import merge as M
    t = Tables(spark, sf)
    w, r = fx.replica_write(t), fx.replica_read(t)
    before = D.snapshot_equal(w, r).select(F.lit("before").alias("stage"), "*")
    synced = M.upsert(M.delete_orphans(r, w, OKEY), w, OKEY)
    after = D.snapshot_equal(w, synced).select(F.lit("after").alias("stage"), "*")
    return before.unionByName(after)


@query
def fn_row_signature(spark, sf):
    o = fx.replica_write(Tables(spark, sf))
    sig = scalar.row_signature(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"),
                               F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderdate"),
                               F.col("o_orderpriority"))
    return o.select("o_orderkey", sig.alias("signature"))


@query
def retype_report(spark, sf):
    from pyspark.sql import types as T
    from ..operators import drift as C
    read = fx.drift_read(Tables(spark, sf))
    return C.retype_report(read, {"o_totalprice": T.DoubleType(), "o_orderstatus": T.IntegerType(),
                                  "o_orderdate": T.DateType(), "legacy_flag": T.DateType()})


# --- FX-COMPOSITE ----------------------------------------------------------
ABKEY = ["author_id", "book_id"]


@query
def orphans_composite_key(spark, sf):
    from ..operators import diff as D
    t = Tables(spark, sf)
    return D.orphans(fx.composite_read(t), fx.composite_write(t), ABKEY)


@query
def delete_orphans_composite(spark, sf):
    from ..operators import merge as M
    t = Tables(spark, sf)
    return M.delete_orphans(fx.composite_read(t), fx.composite_write(t), ABKEY)


# --- FX-NOKEY --------------------------------------------------------------
LKEY = ["l_orderkey", "l_linenumber"]


@query
def replace_no_key(spark, sf):
    from ..operators import merge as M
    t = Tables(spark, sf)
    return M.replace(t.lineitem, t.lineitem.columns)


@query
def unique_violations(spark, sf):
    from ..operators import integrity as I
    return I.unique_violations(Tables(spark, sf).lineitem, LKEY)


@query
def primary_key_check(spark, sf):
    from ..operators import integrity as I
    return I.primary_key_check(Tables(spark, sf).lineitem, LKEY)


# --- FX-CONFLICT -----------------------------------------------------------
@query
def upsert_conflict_pairs(spark, sf):
    from ..operators import merge as M
    t = Tables(spark, sf)
    return M.conflict_holders(fx.conflict_write(t), fx.conflict_read(t), ["c_custkey"], ["c_name"])


# --- FX-FK -----------------------------------------------------------------
def _fk():
    from ..sources.tables import ForeignKey
    return ForeignKey("fk_orders_customer", ("o_custkey",), "customer", ("c_custkey",))


def _fk_line():
    from ..sources.tables import ForeignKey
    return ForeignKey("fk_lineitem_orders", ("l_orderkey",), "orders", ("o_orderkey",))


@query
def fk_orphan_cleanup(spark, sf):
    from ..operators import integrity as I
    t = Tables(spark, sf)
    return I.fk_cleanup(fx.fk_child(t), fx.fk_parent(t), _fk())


@query
def fk_orphan_report(spark, sf):
    from ..operators import integrity as I
    t = Tables(spark, sf)
    return I.fk_orphan_report(fx.fk_child(t), {"customer": fx.fk_parent(t)}, [_fk()], ["o_orderkey"])


@query
def fk_cleanup_chain(spark, sf):
    from ..operators import integrity as I
    t = Tables(spark, sf)
    tables = {"customer": fx.fk_parent(t), "orders": fx.fk_child(t), "lineitem": fx.fk_grandchild(t)}
    out = I.fk_cleanup_chain(tables, {"orders": [_fk()], "lineitem": [_fk_line()]})
    return (out["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query
def null_violations(spark, sf):
    from ..operators import integrity as I
    return I.null_counts(fx.fk_child(Tables(spark, sf)), ["o_orderkey", "o_custkey"])


# --- FX-TEXT ---------------------------------------------------------------
@query
def definition_diff(spark, sf):
    from ..operators import diff as D
    t = Tables(spark, sf)
    return D.definition_diff(fx.text_write(t), fx.text_read(t), "doc_id", "text")


@query
def fn_normalise_definition(spark, sf):
    d = fx.text_read(Tables(spark, sf))
    return d.select("doc_id", scalar.normalise_definition(F.col("text")).alias("normalised"))


# --- FX-ENUM ---------------------------------------------------------------
@query
def enum_domain_drift(spark, sf):
    from ..operators import drift as C
    t = Tables(spark, sf)
    return C.enum_domain_drift(fx.enum_write(t), fx.enum_read(t), "o_orderpriority")


# --- FX-DRIFT --------------------------------------------------------------
@query
def column_drift(spark, sf):
    from ..operators import drift as C
    t = Tables(spark, sf)
    read = fx.drift_read(t)
    w = C.column_catalog(spark, "orders", fx.drift_write(t).schema, keys=("o_orderkey",))
    r = C.column_catalog(spark, "orders", read.schema, keys=("o_orderkey",))
    return C.column_drift(w, r, read_data=read)


@query
def table_set_drift(spark, sf):
    """Write = the tables found by listing the root; read = a replica missing 'pages' and holding a stale 'legacy_region'."""
    from ..operators import drift as C
    from ..sources.inventory import table_names
    w = spark.createDataFrame([(n,) for n in table_names(spark, sf, exclude=())], "table_name string")
    r = w.filter(F.col("table_name") != "pages").unionByName(
        w.filter(F.col("table_name") == "region").select(F.concat(F.lit("legacy_"), "table_name").alias("table_name")))
    return C.table_set_drift(w, r)


@query
def align_schema(spark, sf):
    from ..operators import drift as C
    t = Tables(spark, sf)
    return C.align(fx.drift_read(t), fx.drift_write(t).schema,
                   defaults={"o_orderpriority": "'5-LOW'"}, strict=True)


# --- FX-SEQ / FX-ZIP -------------------------------------------------------
@query
def ordered_array_agg(spark, sf):
    from ..operators import aggregates as A
    s = fx.sequences(Tables(spark, sf))
    return A.ordered_positions(s, ["conv_id"], ["turn"], "role")


@query
def unnest_zip_ordinality(spark, sf):
    from ..operators import relations as R
    z = fx.zip_arrays(Tables(spark, sf))
    return R.unnest_zip(z, "embedding", "reversed", ["vec_id"])


@query
def fn_array_literal(spark, sf):
    """F5 round trip: an id list written as ``{a,b,c}`` text and parsed back."""
    e = Tables(spark, sf).embeddings
    txt = F.concat(F.lit("{"), F.concat_ws(",", F.col("vec_id").cast("string"), F.col("label").cast("string"),
                                           F.size("embedding").cast("string")), F.lit("}"))
    parsed = scalar.parse_array_literal(txt)
    return e.select("vec_id", txt.alias("literal"), F.posexplode(parsed).alias("pos", "elem")).select(
        "vec_id", "literal", (F.col("pos") + 1).cast("bigint").alias("ordinality"),
        F.col("elem").cast("bigint").alias("elem"))


# --- FX-CMD ----------------------------------------------------------------
def _folded(spark, sf):
    from ..operators import commands as K
    return K.fold(fx.commands(Tables(spark, sf)))


@query
def cmd_status(spark, sf):
    from ..operators import commands as K
    return K.status(_folded(spark, sf))


@query
def cmd_create(spark, sf):
    from ..operators import commands as K
    return K.accepted_rows(_folded(spark, sf), K.CREATE)


@query
def cmd_partial_update(spark, sf):
    from ..operators import commands as K
    return K.accepted_rows(_folded(spark, sf), K.UPDATE)


@query
def cmd_delete(spark, sf):
    from ..operators import commands as K
    return K.accepted_rows(_folded(spark, sf), K.DELETE)


@query
def state_from_log(spark, sf):
    from ..operators import commands as K
    return K.current_state(_folded(spark, sf))


@query
def domain_events(spark, sf):
    from ..operators import commands as K
    return K.domain_events(_folded(spark, sf))


@query
def dedupe_events(spark, sf):
    """Created events arrive twice (factory + handler); one copy kept."""
    from ..operators import commands as K
    ev = K.domain_events(_folded(spark, sf))
    doubled = ev.unionByName(ev.filter(F.col("event_type") == "author.created"))
    return K.dedupe_events(doubled)


@query
def route_by_topic(spark, sf):
    from ..operators import commands as K
    return K.route(fx.commands(Tables(spark, sf)))


# --- FX-CMD replies and events ---------------------------------------------
@query
def reply_table(spark, sf):
    from ..operators import commands as K
    return K.replies(_folded(spark, sf))


def _exceptions(spark, sf):
    """Rejected commands as thrown-error records with the status in different places."""
    f = _folded(spark, sf).filter(F.col("code") != 200)
    kind = F.col("event_id") % 4
    cls = (F.when((kind == 3) & (F.col("event_id") % 5 == 0), F.lit("TypeError"))
           .when(F.col("code") == 404, F.lit("NotFoundException")).otherwise(F.lit("BadRequestException")))
    return f.select("event_id", F.when(kind == 0, F.col("code")).alias("get_status"),
                    F.when(kind == 1, F.col("code")).alias("status"),
                    F.when(kind == 2, F.col("code")).alias("status_code"), cls.alias("class_name"))


@query
def error_code_map(spark, sf):
    from ..functions import envelope as E
    x = _exceptions(spark, sf)
    return x.select("event_id", "class_name",
                    E.error_code(F.col("get_status"), F.col("status"), F.col("status_code"),
                                 F.col("class_name")).alias("code"))


@query
def reply_paginated(spark, sf):
    """Per entity, the rows of page 1 (limit 10) of its command history, newest first, with pagination meta.

    The rank is cut to the page inside each map task (window group limit), so a hot entity's rows stay where they are."""
    from pyspark.sql import Window
    from ..functions import envelope as E
    c = fx.commands(Tables(spark, sf))
    per = c.groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    m = E.paginated_meta(F.col("total"), F.lit(1).cast("bigint"), F.lit(10).cast("bigint"))
    newest = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("event_id"))
    page = c.select("id", "event_id", "op", F.row_number().over(newest).alias("position")).filter("position <= 10")
    return page.join(per, "id").select("id", F.lit(True).alias("success"), "event_id", "op", "position", m.alias("p")).select(
        "id", "success", "event_id", "op", F.col("position").cast("bigint").alias("position"), F.col("p.total").alias("total"),
        F.col("p.page").alias("page"), F.col("p.limit").alias("page_limit"), F.col("p.totalPages").alias("total_pages"))


@query
def emit_events_json(spark, sf):
    """Domain events as (topic, key, value JSON) records ready for a sink."""
    from ..operators import commands as K
    ev = K.domain_events(_folded(spark, sf))
    full = F.to_json(F.struct(F.col("event_type").alias("eventType"), F.col("id").alias("id"),
                              F.col("value").alias("value"), F.col("props").alias("props"),
                              scalar.iso_timestamp(F.col("updated_at")).alias("updatedAt"),
                              scalar.iso_timestamp(F.col("occurred_at")).alias("occurredAt")),
                     {"ignoreNullFields": "false"})
    short = F.to_json(F.struct(F.col("event_type").alias("eventType"), F.col("id").alias("id"),
                               scalar.iso_timestamp(F.col("occurred_at")).alias("occurredAt")))
    val = F.when(F.col("event_type").endswith(".deleted"), short).otherwise(full)
    return ev.select("event_id", F.col("event_type").alias("topic"), F.col("id").cast("string").alias("key"),
                     val.alias("value"))


@query
def emit_events_sink(spark, sf):
    """The events written to their topics and read back as a consumer of all topics sees them."""
    import uuid
    from ..session import scratch_path
    from ..streaming import topics
    path = scratch_path(spark, f"emit-{uuid.uuid4().hex}")
    topics.emit(emit_events_json(spark, sf), path)
    back = spark.read.schema(topics.RECORD_SCHEMA).json(f"{path}/*")
    return back.select(F.col("offset").alias("event_id"), "topic", "key", "value")


# --- FX-ASSIGN -------------------------------------------------------------
ASSIGN_ORDER = ["ts", "l_orderkey", "l_linenumber"]


def _assigned(spark, sf):
    from ..operators import commands as K
    t = Tables(spark, sf)
    return K.assign(fx.assign_commands(t), fx.m2n_left(t), fx.m2n_right(t), ASSIGN_ORDER,
                    author_key="s_suppkey", book_key="p_partkey")


@query
def cmd_assign(spark, sf):
    return _assigned(spark, sf).select("l_orderkey", "l_linenumber", "author_id", "book_id", "code", "message")


@query
def assign_parent_check(spark, sf):
    from ..operators import relations as R
    t = Tables(spark, sf)
    ok = R.require_parents(fx.assign_commands(t), [(fx.m2n_left(t), "s_suppkey", "author_id"),
                                                    (fx.m2n_right(t), "p_partkey", "book_id")])
    return ok.select("l_orderkey", "l_linenumber", "author_id", "book_id")


@query
def cmd_unassign(spark, sf):
    """Unassign requests (returned lines) against the links the assign batch created."""
    from ..operators import commands as K
    a = _assigned(spark, sf)
    links = a.filter(F.col("code") == 200).select(
        K.link_id(F.col("author_id"), F.col("book_id")).alias("link_id"), "author_id", "book_id",
        F.col("ts").alias("assigned_at"))
    reqs = a.filter(F.col("l_returnflag") == "R").select(
        "l_orderkey", "l_linenumber", "ts", K.link_id(F.col("author_id"), F.col("book_id")).alias("link_id"))
    out = K.unassign(reqs, links, ASSIGN_ORDER)
    return out.select("l_orderkey", "l_linenumber", "link_id", "code", "author_id", "book_id", "assigned_at", "message")


# --- FX-PAYLOAD ------------------------------------------------------------
def _validated(spark, sf):
    from ..functions import validate as V
    p = fx.payloads(Tables(spark, sf))
    return V.validate(p, V.create_book_rules(F.col("title"), F.col("isbn"), F.col("yr")), ["p_partkey"])


@query
def validate_payloads(spark, sf):
    v = _validated(spark, sf)
    return v.select("p_partkey", "message", F.size("violations").cast("bigint").alias("n_violations"), "is_valid")


@query
def validation_summary(spark, sf):
    from ..functions import validate as V
    return V.summary(_validated(spark, sf))


@query
def length_violations(spark, sf):
    from ..operators import integrity as I
    p = fx.payloads(Tables(spark, sf))
    return I.length_violations(p, {"title": 255, "isbn": 13}, ["p_partkey"])


@query
def cmd_create_unique(spark, sf):
    from ..operators import commands as K
    p = fx.payloads(Tables(spark, sf))
    return K.create_unique(p, "isbn", ["p_partkey"]).select("p_partkey", "isbn", "code", "message")


@query
def error_message_normalise(spark, sf):
    """Validation failures as error replies, code 400; the thrown response holds its message as a list,
    a text, an object, an empty text or not at all."""
    from ..functions import envelope as E
    v = _validated(spark, sf).filter(~F.col("is_valid"))
    k, first = F.col("p_partkey") % 5, F.element_at("violations", 1)
    own = (F.when(k == 0, F.to_json("violations")).when(k == 1, F.concat(F.lit('"'), first, F.lit('"')))
           .when(k == 2, F.concat(F.lit('{"text":"'), first, F.lit('"}'))).when(k == 3, F.lit('""')).otherwise(F.lit("null")))
    response = F.concat(F.lit('{"statusCode":400,"message":'), own, F.lit("}"))
    thrown = F.when(F.col("p_partkey") % 2 == 0, F.lit("Bad Request")).otherwise(F.lit(""))
    return v.select("p_partkey", F.lit(400).alias("error_code"),
                    E.normalise_error_message(response, thrown).alias("error_message"))


# --- FX-REPLY --------------------------------------------------------------
REPLY_TIMEOUT_SECONDS = 10  # default request/reply timeout of the bridge


@query
def reply_timeout(spark, sf):
    """T5 (batch twin): left interval join request -> reply within the timeout; none = 503."""
    from ..streaming.replies import correlate
    t = Tables(spark, sf)
    return correlate(fx.requests(t), fx.replies(t), REPLY_TIMEOUT_SECONDS)


def _inbound(t: Tables):
    e = t.events
    eid = F.col("event_id").cast("string")
    text = (F.when(F.col("event_id") % 11 == 0, F.lit('{"success":false}'))
            .when(F.col("event_id") % 13 == 0, F.lit('{"success":true,"data":null}'))
            .when(F.col("event_id") % 17 == 0, F.concat(F.lit('{"success":true,"data":"text '), eid, F.lit('"}')))
            .when(F.col("event_id") % 19 == 0, F.lit('{"success":false,"error":{"code":{"a":1},"message":"0"}}'))
            .when(F.col("event_id") % 23 == 0, F.concat(
                F.lit('{"success":false,"error":{"code":99999999999,"details":{"field":"f","n":'), eid, F.lit("}}}")))
            .when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"success":true,"id":'), eid, F.lit("}")))
            .when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"success":false,"error":{"code":404,"message":"missing '),
                                                       eid, F.lit('"}}')))
            .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"success":false,"statusCode":"E_TEXT","message":"text code '),
                                                       eid, F.lit('"}')))
            .otherwise(F.concat(F.lit('{"success":true,"data":{"id":'), eid, F.lit(',"v":'),
                                F.col("user_id").cast("string"), F.lit("}}"))))
    return e.select("event_id", text.alias("reply"))


@query
def reply_decode(spark, sf):
    from ..functions import envelope as E
    r = _inbound(Tables(spark, sf))
    return r.select("event_id", "reply", E.decode_inbound(F.col("reply")).alias("d")).select(
        "event_id", F.col("d.ok").alias("ok"), F.col("d.code").alias("code"),
        F.col("d.message").alias("message"), F.col("d.data").alias("data_json"),
        E.inbound_details(F.col("reply")).alias("details_json"))


# --- FX-LOG ----------------------------------------------------------------
LOG_SCHEMA = ("level string, msg string, password string, image string, "
              "user struct<name: string, token: string, image: string, "
              "profile: struct<imageBase64: string, password: string>>, "
              "req struct<headers: struct<authorization: string, host: string>>")


@query
def redact_paths(spark, sf):
    """G1: records of unknown shape; undeclared and null fields stay."""
    from ..functions import redact as G
    logs = fx.log_records(Tables(spark, sf))
    return logs.select("c_custkey", G.redact_json(F.col("record")).alias("redacted"))


@query
def redact_deep(spark, sf):
    """G1 at depth: each record thirty levels down, alone and as the value of a secret name; inside, only the names of any depth count."""
    from ..functions import redact as G
    from ..operators.scan import segment_count
    record = F.col("record")
    deep = F.concat(F.lit('{"a":[' * 15), record, F.lit("]}" * 15))
    hidden = F.concat(F.lit('[{"k":' * 15 + '{"buffer":'), record, F.lit(',"z":1}' + "}]" * 15))
    t = Tables(spark, sf)
    # a megabyte of customers makes records for minutes of one core: small rows are dealt to all cores before they grow
    logs = fx.log_records(t, t.customer.repartition(segment_count(t.customer, 1 << 20)))
    return logs.select("c_custkey", G.redact_json(deep).alias("redacted"), G.redact_json(hidden).alias("hidden"))


@query
def log_level_filter(spark, sf):
    from ..functions import redact as G
    logs = fx.log_records(Tables(spark, sf))
    return G.level_filter(logs, "level", "log").select("c_custkey", "level")


@query
def log_shape(spark, sf):
    from ..functions import redact as G
    logs = fx.log_records(Tables(spark, sf))
    return logs.select("c_custkey", *G.shape(F.col("level"), F.col("context"), F.col("message"), F.col("trace")))


# --- property keys with a query form ---------------------------------------
@query
def sync_empty_source(spark, sf):
    """M5: a write side with no rows (no order has status 'X') empties the replica."""
    from . import sync as S
    from ..sources.tables import TablePair, TableSpec
    t = Tables(spark, sf)
    empty_write = fx.replica_write(t).filter(F.col("o_orderstatus") == "X")
    res = S.sync_table(TablePair(TableSpec("orders", keys=tuple(OKEY)), empty_write, fx.replica_read(t)))
    return res.new_read


@query
def rebuild_on_key_type_change(spark, sf):
    """The replica's key column has drifted to text, so the table is rebuilt from write."""
    from ..operators import merge as M
    t = Tables(spark, sf)
    drifted = fx.replica_read(t).withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    table, rebuilt = M.rebuild_on_key_type_change(drifted, fx.replica_write(t), OKEY)
    return table.withColumn("rebuilt", F.lit(rebuilt))


# --- streaming twins (must equal the batch forms) --------------------------
def _applied_stream(spark, sf):
    from ..streaming import twins
    return twins.applied_run(spark, fx.commands(Tables(spark, sf)))


@query
def stream_cmd_status(spark, sf):
    """T1-T3 on a stream: per-command codes equal the batch cmd_status."""
    return _applied_stream(spark, sf).select("event_id", "id", "op", "code")


@query
def stream_state_from_log(spark, sf):
    """The state after the stream equals the batch state_from_log."""
    from ..operators import commands as K
    return K.current_state(_applied_stream(spark, sf))


@query
def stream_domain_events(spark, sf):
    """T4: events emitted by the stateful apply equal the batch domain_events."""
    from ..streaming import commands as SC
    return SC.events_from_applied(_applied_stream(spark, sf))


@query
def stream_dedupe_events(spark, sf):
    """Created events delivered twice, deduplicated within the watermark."""
    from ..operators import commands as K
    from ..streaming import twins
    ev = K.domain_events(_folded(spark, sf))
    doubled = ev.unionByName(ev.filter(F.col("event_type") == "author.created"))
    return twins.dedupe_run(spark, doubled)


@query
def stream_cdc_apply(spark, sf):
    """The change log applied batch by batch leaves the replica equal to write."""
    from ..streaming import twins
    t = Tables(spark, sf)
    return twins.cdc_run(spark, fx.replica_read(t), _change_log(t), "orders", OKEY)


@query
def cdc_bucketed(spark, sf):
    """T6 on buckets: changes of every line item, arriving out of order, over the replica of orders."""
    from ..streaming import twins
    t = Tables(spark, sf)
    replica = twins.bucketed_cdc_run(spark, t.orders, fx.order_changes(t), "orders", ("o_orderkey",), "arrived", buckets=16)
    return replica.read(spark)


@query
def upsert_unique_index(spark, sf):
    """M7: one batch of renames over a unique column: swaps and freed names pass, real clashes are refused."""
    import uuid
    from ..session import scratch_path
    from ..sources.buckets import BucketedTable
    from ..sources.unique_index import UniqueReplica
    t = Tables(spark, sf)
    replica = UniqueReplica(BucketedTable(scratch_path(spark, f"unique-{uuid.uuid4().hex}"), "customer", ("c_custkey",), buckets=8), ("c_name",))
    replica.create(t.customer.select("c_custkey", "c_name"))
    _done, refused = replica.apply(fx.renames(t))
    return replica.table.read(spark).join(refused.select("c_custkey", F.lit(True).alias("r")), "c_custkey", "left").select(
        "c_custkey", "c_name", F.coalesce("r", F.lit(False)).alias("refused"))


@query
def sync_bucketed(spark, sf):
    """M8, M10 on buckets: requested rows taken over from write, then the returned orders' rows deleted."""
    import uuid
    from ..session import scratch_path
    from ..sources.buckets import BucketedTable
    t = Tables(spark, sf)
    replica = BucketedTable(scratch_path(spark, f"sync-buckets-{uuid.uuid4().hex}"), "orders", ("o_orderkey",), buckets=16)
    replica.create(fx.replica_read(t))
    replica.sync_rows(_requested_ids(t), fx.replica_write(t), seq=1)
    replica.delete_rows(t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey")), seq=2)
    return replica.read(spark)


@query
def stream_reply_timeout(spark, sf):
    """T5 on streams: equals the batch interval join."""
    from ..streaming import twins
    t = Tables(spark, sf)
    return twins.timeout_run(spark, fx.requests(t), fx.replies(t), REPLY_TIMEOUT_SECONDS)


@query
def stream_reply_late(spark, sf):
    """T5: replies that come after their request timed out are given back as late; each input row is answered, timed out or late."""
    from ..streaming import twins
    t = Tables(spark, sf)
    return twins.accounted_run(spark, fx.requests(t), fx.replies(t), REPLY_TIMEOUT_SECONDS, lateness="9 days")[0]


@query
def reply_normalise(spark, sf):
    """Handler results of the accepted commands in their four shapes, as replies."""
    from ..functions import envelope as E
    f = _folded(spark, sf).filter(F.col("code") == 200)
    idj = F.col("id").cast("string")
    result = (F.when((F.col("op") == "get") & (F.col("event_id") % 3 == 0),
                     F.concat(F.lit('{"data":{"id":'), idj, F.lit('},"meta":{"page":1,"source":"'), F.col("op"),
                              F.lit('"}}')))
              .when((F.col("op") == "get") & (F.col("event_id") % 3 == 1), F.lit('{"data":"text","meta":{"page":2}}'))
              .when((F.col("op") == "update") & (F.col("event_id") % 4 == 0),
                    F.lit('{"success":false,"error":{"message":"m","code":409}}'))
              .when(F.col("op") == "update", F.concat(F.lit('{"success":true,"data":{"id":'), idj, F.lit("}}")))
              .when(F.col("op") == "delete", F.lit(None).cast("string"))
              .otherwise(F.concat(F.lit('{"id":'), idj, F.lit("}"))))
    r = f.select("event_id", E.normalise_result(result, F.col("ts")).alias("r"))
    return r.select("event_id", "r.kind", "r.success", F.col("r.data").alias("data_json"),
                    F.col("r.meta").alias("meta_json"), F.col("r.error").alias("error_json"), "r.timestamp")


@query
def error_details(spark, sf):
    """E5: validation error responses; extra response fields become the details."""
    from ..functions import envelope as E
    v = _validated(spark, sf).filter(~F.col("is_valid"))
    msgs = F.concat(F.lit('["'), F.array_join("violations", '","'), F.lit('"]'))
    prop = F.substring_index(F.element_at("violations", 1), " ", 1)
    extra = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit(',"property":"'), prop, F.lit('"'))).otherwise(F.lit(""))
    resp = F.concat(F.lit('{"statusCode":400,"message":'), msgs, F.lit(',"error":"Bad Request"'), extra, F.lit("}"))
    return v.select("p_partkey", E.normalise_message(F.col("violations"), F.lit(None).cast("string")).alias("error_message"),
                    E.error_details(resp).alias("details_json"))


@query
def reply_details(spark, sf):
    """The whole error reply of every rejected payload, with its details."""
    from ..functions import envelope as E
    v = _validated(spark, sf).filter(~F.col("is_valid"))
    prop = F.substring_index(F.element_at("violations", 1), " ", 1)
    details = F.when(F.size("violations") > 1, F.to_json(F.struct(prop.alias("property"), F.size("violations").alias("count"))))
    when = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    r = v.select("p_partkey", E.error(E.normalise_message(F.col("violations"), F.lit(None).cast("string")), F.lit(400), when, details).alias("r"))
    return r.select("p_partkey", "r.success", F.col("r.error.code").alias("error_code"), F.col("r.error.message").alias("error_message"),
                    F.col("r.error.details").alias("details_json"), F.col("r.meta.timestamp").alias("timestamp"))


@query
def catalog_drift(spark, sf):
    """Per column of events, defaults compared after normalising and nullability against the nulls that the data hold."""
    from pyspark.sql import types as T
    from ..operators import drift as C
    e = Tables(spark, sf).events
    strict = T.StructType([T.StructField(f.name, f.dataType, f.name in ("value", "props")) for f in e.schema.fields])
    read = e.select(*[F.when(F.col("event_id") % 17 != 0, F.col("props")).alias(c) if c == "props" else F.col(c) for c in e.columns])
    w = C.column_catalog(spark, "events", strict, ("event_id",), {"value": "0.0", "event_type": "'view'", "props": " NULL "})
    r = C.column_catalog(spark, "events", e.schema, ("event_id",), {"value": "( 1.0 )", "event_type": "  'view'", "props": "NULL"})
    d = C.column_drift(w, r, read_data=read)
    return d.select("column_name", "change", "read_nulls", ((F.col("change") == "tighten_null") & (F.col("read_nulls") == 0)).alias("can_tighten"))


@query
def tables_with_rows(spark, sf):
    """A5: the emptiness test (at most one row read) for each table and for a filter that no row meets."""
    from ..operators import aggregates as A
    from ..sources.inventory import table_names
    t = Tables(spark, sf)
    found = [(n, A.non_empty(t[n])) for n in table_names(spark, sf)]
    return spark.createDataFrame([*found, ("orders with status X", A.non_empty(t.orders.filter("o_orderstatus = 'X'")))], "table_name string, has_rows boolean")


@query
def stream_reply_table(spark, sf):
    """Replies of the streamed commands written per micro-batch by an idempotent
    foreachBatch sink; equals the batch reply_table."""
    from ..streaming import twins
    return twins.replies_run(spark, fx.commands(Tables(spark, sf)))


@query
def validate_author_payloads(spark, sf):
    """Author.create rules; birthDate is required as declared."""
    from ..functions import validate as V
    p = fx.author_payloads(Tables(spark, sf))
    v = V.validate(p, V.create_author_rules(F.col("first_name"), F.col("last_name"), F.col("birth_date")),
                   ["c_custkey"])
    return v.select("c_custkey", "message", "is_valid")


@query
def stream_state_tws(spark, sf):
    """T3 on transformWithStateInPandas (ValueState per entity): state equals the batch state_from_log."""
    from ..operators import commands as K
    from ..streaming import twins
    applied = twins.applied_run(spark, fx.commands(Tables(spark, sf)), api="transform_with_state")
    return K.current_state(applied)


@query
def stream_ordered_fold(spark, sf):
    """T3 in event time: commands arriving out of order are folded in order; those behind the watermark come out as late."""
    from ..streaming import twins
    applied, late = twins.ordered_run(spark, fx.arriving_commands(Tables(spark, sf)), "arrived", delay="12 days", slot_ms=5 * 86_400_000)
    cols = ["event_id", "id", "op", "code", "value", "props", "created_at", "updated_at"]
    none = [F.lit(None).cast(applied.schema[c].dataType).alias(c) for c in cols[3:]]
    return applied.select(*cols, F.lit(False).alias("late")).unionByName(late.select(*cols[:3], *none, F.lit(True).alias("late")))


# --- FX-MSG: all topics ------------------------------------------------------
@query
def validate_messages(spark, sf):
    """V1-V11 over the rule sets of all twelve topics, judged by JSON type."""
    from ..functions import validate as V
    m = fx.messages(Tables(spark, sf))
    m = m.select("event_id", "topic", F.try_parse_json("payload").alias("message"))
    v = m.select("event_id", "topic", V.topic_violations(F.col("topic"), F.col("message")).alias("violations"))
    return v.select("event_id", "topic", F.array_join("violations", "; ").alias("message"),
                    F.size("violations").cast("bigint").alias("n_violations"))


@query
def route_messages(spark, sf):
    """The command fields of every topic; other payload fields are dropped."""
    from ..operators import commands as K
    return K.route_messages(fx.messages(Tables(spark, sf)))


def _assignment_log(spark, sf):
    from ..operators import commands as K
    t = Tables(spark, sf)
    log = fx.assign_commands(t).withColumn("op", F.when(F.col("l_returnflag") == "R", "unassign").otherwise("assign"))
    stored = fx.m2n_link(t).filter((F.col("author_id") + F.col("book_id")) % 10 == 3)
    return K.assignment_log(log, fx.m2n_left(t), fx.m2n_right(t), ASSIGN_ORDER, author_key="s_suppkey",
                            book_key="p_partkey", existing_links=stored)


@query
def cmd_assignment_log(spark, sf):
    """K8-K10 folded in one order over stored links: a pair may be assigned again after it was unassigned."""
    return _assignment_log(spark, sf).select("l_orderkey", "l_linenumber", "op", "author_id", "book_id", "code", "message")


@query
def assignment_events(spark, sf):
    """Created and deleted events of the assignment log."""
    from ..operators import commands as K
    return K.assignment_events(_assignment_log(spark, sf), keep=("l_orderkey", "l_linenumber"))


# --- FX-LIVES: parents as of the request ---------------------------------------
def _judged_asof(spark, sf):
    from ..operators import asof as A
    t = Tables(spark, sf)
    lives = fx.parent_lives(t, "author_id", 7), fx.parent_lives(t, "book_id", 6)
    stored = {"authors": fx.stored_parents(t, "author_id"), "books": fx.stored_parents(t, "book_id"), "links": fx.stored_links(t)}
    return A.assignments_asof(fx.link_requests(t), *lives, fx.LIFE_ORDER, **stored), lives, stored


@query
def assignment_asof(spark, sf):
    """K7, K8: link requests against authors and books that are deleted and created again meanwhile."""
    judged, _, _ = _judged_asof(spark, sf)
    return judged.select(*fx.LIFE_ORDER[1:], "op", "author_id", "book_id", "code", "message")


@query
def links_asof(spark, sf):
    """The links left after requests and deletes of parents, each with the line that made it."""
    from ..operators import asof as A
    judged, lives, stored = _judged_asof(spark, sf)
    out = A.links_after(judged, *lives, fx.LIFE_ORDER, **stored)
    return out.select("author_id", "book_id", F.col("at.l_orderkey").alias("l_orderkey"), F.col("at.l_linenumber").alias("l_linenumber"))


@query
def cmd_unique_lifecycle(spark, sf):
    """K2: unique values claimed by creates and updates, freed by updates and deletes, over stored holders."""
    from ..operators import unique as U
    t = Tables(spark, sf)
    judged, _rounds = U.judge_unique(fx.unique_commands(t), "isbn", ["ts", "event_id"], has="has", stored=fx.unique_holders(t))
    return judged.select("event_id", "id", "op", "isbn", "code", "message")


# --- operators that no other key reaches --------------------------------------
@query
def entity_to_aggregate(spark, sf):
    """Stored rows under the aggregate's field names, F7 key text and F11 YES/NO beside them."""
    from ..operators import commands as K
    p = Tables(spark, sf).part
    e = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("published_year"),
                 scalar.composite_key_json(F.col("p_partkey"), F.col("p_size")).alias("key_json"),
                 scalar.yes_no(F.col("p_size") > 25).alias("is_large"))
    return K.to_aggregate(e, K.BOOK_COLUMNS)


@query
def exists_flag(spark, sf):
    """Per order line, whether its order is on the replica."""
    from ..operators import aggregates as A
    t = Tables(spark, sf)
    probe = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return A.exists_in(fx.replica_read(t), probe, ["o_orderkey"])


@query
def label_difference(spark, sf):
    """D3: per vector, the leading labels the replica lacks, in the write side's order."""
    from ..operators import diff as D
    e = Tables(spark, sf).embeddings.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (
        (F.col("label") * (i + 1) + F.col("vec_id")) % 7).cast("bigint")).alias("w"))
    read = F.array(*[F.lit(x).cast("bigint") for x in (1, 4)])
    return e.select("vec_id", F.posexplode(D.label_set_diff(F.col("w"), read)).alias("position", "label")).select(
        "vec_id", F.col("position").cast("bigint").alias("position"), "label")
