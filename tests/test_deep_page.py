"""Deep pages equal the sorted list, whatever the ties and nulls, and never sort what lies before them."""

import random

import pytest

from twinlake.operators import listing


def table(spark, n, hot):
    rng = random.Random(n)
    rows = [(i if rng.random() < 0.97 else None, 7 if rng.random() < hot else rng.choice([None, *range(40)])) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k long, c long")


@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_pages_of_all_depths(spark, hot):
    rows, df = table(spark, 3000, hot)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or 0))
    for page in (1, 2, 17, 60, 75, 100, 120, 200):
        got = [tuple(r) for r in listing.deep_page(df, listing.PageRequest(page, 25), "c", "k", ranges=6, small=60).collect()]
        assert got == want[(page - 1) * 25: page * 25], page


def test_the_last_sort_is_small(spark):
    df = spark.range(50_000).selectExpr("id AS k", "id % 3 AS c")
    out = listing.deep_page(df, listing.PageRequest(2500, 10), "c", "k", small=500)
    assert [r["k"] for r in out.collect()] == [r["k"] for r in listing.page(df, listing.PageRequest(2500, 10), "c", "k").collect()]
    plan = out._jdf.queryExecution().executedPlan().toString()
    import re
    limits = [int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan)]
    assert limits and max(limits) <= 510


def test_past_the_end_and_empty(spark):
    df = spark.range(100).selectExpr("id AS k", "id AS c")
    assert listing.deep_page(df, listing.PageRequest(50, 10), "c", "k", small=20).collect() == []
    assert listing.deep_page(df.limit(0), listing.PageRequest(50, 10), "c", "k", small=20).collect() == []
