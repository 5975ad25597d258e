"""Regression anchors of SURVEY §5.3 (measured at sf0.01), checked on the Spark side."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

from .conftest import SF_MID


def q(spark, key):
    return E.queries()[key](spark, SF_MID)


def counts(df, *cols):
    return {tuple(r[:-1]) if len(r) > 2 else r[0]: r[-1]
            for r in df.groupBy(*cols).count().collect()}


def test_listing_anchor(spark):
    m = q(spark, "list_page_meta").first()
    assert (m["total"], m["total_pages"]) == (4933, 494)
    assert q(spark, "list_page").count() == 10


def test_replica_anchors(spark):
    assert counts(q(spark, "row_diff"), "action") == {"insert": 1500, "update": 1929, "delete": 300, "same": 11571}
    assert q(spark, "orphans_single_key").count() == 300
    assert q(spark, "orphans_composite_key").count() == 1049
    kept = q(spark, "fk_orphan_cleanup")
    assert (kept.count(), kept.filter("o_custkey IS NOT NULL").count()) == (13741, 12587)
    assert q(spark, "unique_violations").count() == 11785
    assert q(spark, "upsert_conflict_pairs").count() == 15


def test_relation_anchors(spark):
    m = q(spark, "m2n_expand_left").agg(F.count("*"), F.sum("n_related")).first()
    assert tuple(m) == (100, 51731)
    assert q(spark, "cascade_delete").count() == 43777
    h = q(spark, "key_high_water_mark").first()
    assert (h["max_key"], h["next_value"]) == (14999, 15000)
    assert [r["label"] for r in q(spark, "enum_domain_drift").collect()] == ["1-URGENT"]


def test_command_anchors(spark):
    assert counts(q(spark, "cmd_status"), "op", "code") == {
        ("create", 200): 1047, ("create", 400): 970, ("update", 200): 994, ("update", 404): 1012,
        ("delete", 200): 968, ("delete", 404): 1046, ("get", 200): 1952, ("get", 404): 2011}
    assert q(spark, "state_from_log").count() == 79
    a = q(spark, "cmd_assign").withColumn("who", F.substring("message", 1, 4))
    assert counts(a, "code", "who") == {(200, None): 48170, (404, "Auth"): 3022, (404, "Book"): 1101,
                                       (409, "Auth"): 7707}


@pytest.mark.parametrize("key,expected", [
    ("reply_timeout", {200: 7083, 503: 2917}),  # every event is a request; the figures are those of the oracle
    ("definition_diff", {"create": 100, "drop": 100, "recreate": 134, "same": 666}),
])
def test_misc_anchors(spark, key, expected):
    col = "code" if key == "reply_timeout" else "action"
    assert counts(q(spark, key), col) == expected


def test_validation_anchor(spark):
    s = q(spark, "validation_summary")
    assert s.count() == 12
    assert s.filter("message = ''").first()["n_rows"] == 1152
