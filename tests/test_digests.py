"""Row diff by bucket digests: equal to the full diff, and equal buckets are not read."""

import random

import pytest
from pyspark.sql import functions as F

from twinlake.operators.diff import row_diff
from twinlake.sources.buckets import BucketedTable
from twinlake.sources.digests import DigestedTable, bucket_counts, differing_buckets, pruned_row_diff, row_words, snapshots_equal

SCHEMA = "id bigint, part string, v string, at timestamp, tags array<string>"
KEYS = ("id", "part")


def table(spark, root, name, rows, n=16):
    out = DigestedTable(BucketedTable(root, name, KEYS, n))
    out.table.create(spark.createDataFrame(rows, SCHEMA).withColumn("at", F.coalesce("at", F.expr("timestamp_micros(id)"))))
    return out


def rows(n=120):
    return [(i, "ab"[i % 2], f"v{i}", None, ["x", str(i)] if i % 3 else None) for i in range(n)]


def actions(df):
    return sorted((r["id"], r["part"], r["action"]) for r in df.collect())


def change(key, seq, op="delete", row=None):
    return (*key, seq, op, row)


CHANGES = f"id bigint, part string, seq bigint, op string, row struct<{SCHEMA.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>"


def test_equals_the_full_diff(spark, tmp_root):
    rng = random.Random(2)
    ours = rows()
    theirs = [(*r[:2], rng.choice([None, "", "new"]), *r[3:]) if rng.random() < 0.1 else r for r in ours if rng.random() > 0.1]
    theirs += [(1000 + i, "z", "own", None, None) for i in range(4)]
    w, r = table(spark, tmp_root, "w", ours), table(spark, tmp_root, "r", theirs)
    want = row_diff(w.table.read(spark), r.table.read(spark), list(KEYS))
    assert actions(pruned_row_diff(spark, w, r)) == actions(want)
    assert actions(pruned_row_diff(spark, w, r, same=False)) == actions(want.filter("action <> 'same'"))
    counts = bucket_counts(spark, w, r).agg(F.sum("n_write"), F.sum("n_read"), F.min("is_equal")).first()
    assert tuple(counts) == (len(ours), len(theirs), False) and not snapshots_equal(spark, w, r)


def test_equal_buckets_are_not_read(spark, tmp_root):
    w, r = table(spark, tmp_root, "w", rows()), table(spark, tmp_root, "r", list(reversed(rows())))
    assert snapshots_equal(spark, w, r) and pruned_row_diff(spark, w, r, same=False).count() == 0
    done = w.table.apply(spark.createDataFrame([change((5, "b"), 1)], CHANGES))
    assert differing_buckets(spark, w, r) == list(done.buckets) and len(done.buckets) == 1
    diff = pruned_row_diff(spark, w, r, same=False)
    assert actions(diff) == [(5, "b", "delete")]
    named = {t.table.manifest(spark)[1][done.buckets[0]] for t in (w, r)}
    files = diff.inputFiles()
    assert files and all(any(n in f for n in named) for f in files)
    listed = pruned_row_diff(spark, w, r)
    assert listed.count() == 120
    scans = [line for line in listed._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line]
    assert any("v:string" not in line for line in scans)  # equal buckets: keys only


def test_only_new_file_sets_are_digested(spark, tmp_root):
    w = table(spark, tmp_root, "w", rows())
    first, read = w.refresh(spark)
    assert read == sorted(first)
    assert w.refresh(spark) == (first, [])
    done = w.table.apply(spark.createDataFrame([change((7, "b"), 1), change((8, "a"), 1)], CHANGES))
    second, read = w.refresh(spark)
    assert read == list(done.buckets) and {b for b in first if first[b] != second[b]} == set(done.buckets)


def test_deleted_and_empty_buckets(spark, tmp_root):
    w, r = table(spark, tmp_root, "w", rows(3), n=64), table(spark, tmp_root, "r", [], n=64)
    assert actions(pruned_row_diff(spark, w, r)) == [(i, "ab"[i % 2], "insert") for i in range(3)]
    w.table.apply(spark.createDataFrame([change((i, "ab"[i % 2]), 1) for i in range(3)], CHANGES))
    assert snapshots_equal(spark, w, r) and pruned_row_diff(spark, w, r).count() == 0
    with pytest.raises(ValueError):
        differing_buckets(spark, w, table(spark, tmp_root, "other", [], n=8))


def test_digests_tell_close_rows_apart(spark):
    close = [(None, "a"), ("", "a"), ("a", ""), ("a", None), ('{"v":"a"}', ""), ("1:a", "2"), ("1:", "a2")]
    df = spark.createDataFrame(close, "x string, y string").select(F.concat_ws(",", *[w.cast("string") for w in row_words(["x", "y"])]).alias("w"))
    assert df.distinct().count() == len(close)
    micros = spark.sql("SELECT timestamp_micros(id) AS at FROM range(3)").select(F.concat_ws(",", *[w.cast("string") for w in row_words(["at"])]).alias("w"))
    assert micros.distinct().count() == 3
