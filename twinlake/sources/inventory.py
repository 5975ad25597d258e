"""S3: table enumeration with an exclusion list and per-table row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables, _fs

DEFAULT_EXCLUDE = ("migrations",)


def table_names(spark: SparkSession, root: str, exclude: tuple[str, ...] = DEFAULT_EXCLUDE) -> list[str]:
    """S3: the Parquet tables under a root, by listing it through the Hadoop file system (no data is read)."""
    fs, p = _fs(spark, root)
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(n[:-len(".parquet")] for n in names if n.endswith(".parquet") and n[:-len(".parquet")] not in exclude)


def table_inventory(t: Tables, exclude: tuple[str, ...] = DEFAULT_EXCLUDE) -> DataFrame:
    """``(table_name, n_rows)`` for every table not excluded, name-ordered.

    The tables are those found by listing the root.  One union of per-table count aggregates: a single job whose
    scans read only Parquet footers' row groups (count pushes no columns).
    """
    names = table_names(t.spark, t.root, exclude)
    parts = [t[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n in names]
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy("table_name")
