"""Filtered, sorted and paged listings over a replica table.

A listing is two Spark jobs, as in the reference's page + count: the page is one
``TakeOrderedAndProject`` (a per-partition top-(offset+limit) then a merge, so the
sort never moves the table), the total is a partial-aggregated count.  Filters are
plain column equalities, so Parquet pushdown and column pruning apply.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Absent:
    def __repr__(self) -> str:
        return "ABSENT"


ABSENT = _Absent()  # a filter field that was not sent (distinct from an explicit None)

DEFAULT_PAGE = 1
DEFAULT_LIMIT = 10
MAX_LIMIT = 100


@dataclass(frozen=True)
class PageRequest:
    page: int = DEFAULT_PAGE
    limit: int = DEFAULT_LIMIT

    def __post_init__(self):
        if not isinstance(self.page, int) or self.page < 1:
            raise ValueError(f"page must be an integer >= 1, got {self.page!r}")
        if not isinstance(self.limit, int) or not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be an integer in 1..{MAX_LIMIT}, got {self.limit!r}")

    @property
    def skip(self) -> int:
        return (self.page - 1) * self.limit


def equality_predicate(filters: dict) -> Column | None:
    """AND of exact equalities over the fields that were sent.

    ``ABSENT`` values are dropped; an explicit ``None`` matches NULL.  No fields
    left means no predicate (all rows).
    """
    preds = []
    for name, value in filters.items():
        if value is ABSENT:
            continue
        preds.append(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return reduce(lambda a, b: a & b, preds) if preds else None


def filter_eq(df: DataFrame, filters: dict) -> DataFrame:
    pred = equality_predicate(filters)
    return df if pred is None else df.filter(pred)


def newest_first(df: DataFrame, created: str, key: str) -> DataFrame:
    """L1: created DESC with the key as tie-break (the reference has none)."""
    return df.orderBy(F.col(created).desc(), F.col(key).asc())


def page(df: DataFrame, req: PageRequest, created: str, key: str) -> DataFrame:
    """L2: one page of the newest-first listing."""
    return newest_first(df, created, key).offset(req.skip).limit(req.limit)


def deep_page(df: DataFrame, req: PageRequest, created: str, key: str, ranges: int = 64, small: int = 10_000) -> DataFrame:
    """L2 for pages of any depth: the same rows as ``page`` without sorting everything before them.

    The page is located by counts.  Quantiles of the order column (values of it) cut the rows into single values and open
    ranges between them, a partial aggregate counts each part, and the search goes on in the part where the page begins: by
    ``created`` first, by ``key`` once a single ``created`` value is left.  What the page needs of the parts behind it is
    taken from their top.  Each round reads two columns under a pushed range filter and brings at most 2 * ``ranges`` numbers
    to the driver; in the end fewer than ``small`` rows are skipped.  Quantiles may be approximate, the counts are exact.  Both
    columns must be numbers, dates or times; null ``created`` values come last, null keys first, as in ``page``.
    """
    order = [F.col(created).desc(), F.col(key)]
    skip, limit, left, by, pieces = (req.page - 1) * req.limit, req.limit, df, created, []
    while skip + limit > small:
        c = F.col(by)
        cuts = left.agg(F.percentile_approx(by, [i / ranges for i in range(ranges + 1)], 100 * ranges).alias("q")).first()["q"]  # one row
        cuts = sorted(set(cuts or []))
        below = reduce(lambda a, b: a + b, [(c > F.lit(q)).cast("int") for q in cuts], F.lit(0))
        part = F.when(c.isNull(), -1).otherwise(2 * below + c.isin(cuts).cast("int") if cuts else F.lit(0))
        sizes = {r["p"]: r["n"] for r in left.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        here, taken = [], 0
        for p in sorted(sizes, reverse=by == created):
            if not here and sizes[p] <= skip:
                skip -= sizes[p]
                continue
            here.append(p)
            taken += sizes[p]
            if taken >= skip + limit:
                break
        if not here:
            return df.limit(0)
        first, own = here[0], sizes[here[0]] - skip
        if own < limit and here[1:]:
            pieces.append(left.filter(part.isin(here[1:])).orderBy(*order).limit(limit - own))
            limit = own
        k, single = first // 2, first % 2 == 1 or first == -1
        if first == -1:
            left = left.filter(c.isNull())
        elif single:
            left = left.filter(c == F.lit(cuts[k]))
        else:  # an open range
            left = left.filter((c > F.lit(cuts[k - 1]) if k else F.lit(True)) & (c < F.lit(cuts[k]) if k < len(cuts) else F.lit(True)))
        if single and by == key:
            break  # equal (created, key) pairs: any order
        by = key if single else by
    out = left.orderBy(*order).offset(skip).limit(limit)
    return reduce(lambda a, b: a.unionByName(b), pieces, out).orderBy(*order)


def total_pages(total: Column | int, limit: int):
    if isinstance(total, int):
        return int(math.ceil(total / limit))
    return F.ceil(total / F.lit(limit)).cast("bigint")


def page_meta(df: DataFrame, req: PageRequest) -> DataFrame:
    """A1 + A7: one row (page, page_limit, total, total_pages)."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total")).select(
        F.lit(req.page).cast("bigint").alias("page"),
        F.lit(req.limit).cast("bigint").alias("page_limit"),
        "total",
        total_pages(F.col("total"), req.limit).alias("total_pages"))


def page_with_meta(df: DataFrame, req: PageRequest, created: str, key: str) -> DataFrame:
    """L4: the page rows carrying the meta fields.

    The total is one scalar (an aggregate job); it is attached to the <=100 page
    rows as literals instead of joining a meta relation.
    """
    total = df.count()
    return page(df, req, created, key).select(
        "*",
        F.lit(req.page).cast("bigint").alias("page"),
        F.lit(req.limit).cast("bigint").alias("page_limit"),
        F.lit(total).cast("bigint").alias("total"),
        F.lit(total_pages(total, req.limit)).cast("bigint").alias("total_pages"))


def lookup_by_id(df: DataFrame, key: str, value) -> DataFrame:
    """0 or 1 row; the equality is pushed into the Parquet scan."""
    return df.filter(F.col(key) == F.lit(value))


def lookup_many(ids: DataFrame, df: DataFrame, id_col: str, key: str) -> DataFrame:
    """One row per requested id with status 200 (found) or 404.

    A left join keeps every request; the request side may be as large as the
    table, so no broadcast is forced (AQE broadcasts it only when measured small).
    """
    req = ids.select(F.col(id_col).alias("_req_id"))
    found = df.withColumn("_found", F.lit(True))
    out = req.join(found, F.col("_req_id") == F.col(key), "left")
    return out.select(
        F.col("_req_id").alias(id_col),
        *[F.col(c) for c in df.columns if c != id_col],
        F.when(F.col("_found"), F.lit(200)).otherwise(F.lit(404)).alias("status"))


def high_water_mark(df: DataFrame, key: str, start: int = 1) -> DataFrame:
    """A3: max(key); at or past ``start`` the sequence is 'called' and continues
    after it, otherwise it restarts at ``start`` uncalled."""
    m = F.max(F.col(key)).alias("max_key")
    agg = df.agg(m)
    called = F.coalesce(F.col("max_key") >= F.lit(start), F.lit(False))
    return agg.select(
        "max_key",
        F.when(called, F.col("max_key")).otherwise(F.lit(start)).cast("bigint").alias("last_value"),
        called.alias("is_called"),
        F.when(called, F.col("max_key") + 1).otherwise(F.lit(start)).cast("bigint").alias("next_value"))


def member_of(value: Column, array: Column) -> Column:
    """``value = ANY(array)``."""
    return F.array_contains(array, value)
