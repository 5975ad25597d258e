"""Plan-shape checks: the scale properties the design relies on, asserted on physical plans."""

import re

import pytest

from twinlake.plans.queries import QUERIES

from .conftest import SF_SMALL

# keys whose plan function itself runs Spark jobs that write (streams, snapshots): covered elsewhere
SIDE_EFFECT_KEYS = {k for k in QUERIES if k.startswith("stream_")} | {
    "sync_all", "sync_table_set", "cdc_bucketed", "row_diff_pruned", "sync_bucketed", "upsert_unique_index", "emit_events_sink", "cmd_unique_lifecycle"}
# the reply shape of one listing page collects the related rows of its ten entities
SIDE_EFFECT_KEYS.add("m2n_nested_page")
KEYS = sorted(set(QUERIES) - SIDE_EFFECT_KEYS)


def plan(df) -> str:
    """The formatted explain text (full scan metadata, unlike the tree string)."""
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("key", KEYS)
def test_no_nested_loop_no_collect(spark, key):
    p = plan(QUERIES[key](spark, SF_SMALL))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p), key
    assert not re.search(r"collect_list|collect_set", p), key


def test_page_is_one_take_ordered(spark):
    p = plan(QUERIES["list_page"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p and "Exchange rangepartitioning" not in p


def test_filters_pushed_to_parquet(spark):
    p = plan(QUERIES["list_filter_eq"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", p)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderpriority,1-URGENT\)", p)


def test_key_scan_reads_only_keys(spark):
    p = plan(QUERIES["scan_keys"](spark, SF_SMALL))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint>", p)


def test_orphan_detection_reads_only_write_keys(spark):
    p = plan(QUERIES["orphans_single_key"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint>" in p


def test_command_fold_has_no_per_key_window_over_rows(spark):
    df = QUERIES["state_from_log"](spark, SF_SMALL)
    df.collect()  # run so the adaptive plan is final
    p = df._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", p)
    assert windows
    for part, order in windows:
        # either a local window per (id, segment) or the carry window over segment summaries
        assert "_seg" in part or "_seg" in order
