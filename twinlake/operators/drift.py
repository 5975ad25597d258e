"""Schema drift detection and alignment (C1-C9), with schema held as data.

Column catalogs are small DataFrames built from ``StructType`` (one row per
column — bounded by the schema, not the data); drift is a full outer join of
two catalogs.  Alignment is a single ``select`` over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import normalise_expression

CATALOG_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("is_nullable", T.BooleanType(), False),
    T.StructField("column_default", T.StringType(), True),
    T.StructField("is_key", T.BooleanType(), False),
])


def column_catalog(spark: SparkSession, table: str, schema: T.StructType,
                   keys: tuple[str, ...] = (), defaults: dict | None = None) -> DataFrame:
    """Schema as data: ``(table_name, ordinal, column_name, data_type, is_nullable, column_default, is_key)``."""
    defaults = defaults or {}
    rows = [(table, i + 1, f.name, f.dataType.simpleString(), bool(f.nullable), defaults.get(f.name), f.name in keys)
            for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def column_drift(write_cat: DataFrame, read_cat: DataFrame, read_data: DataFrame | None = None) -> DataFrame:
    """One row per (column, change).

    change in add | drop | retype | retype_key | redefault | relax_null | tighten_null | same.
    A column may carry several changes (type and nullability), each its own row.
    With ``read_data``, each row also carries ``read_nulls``, the NULL count of
    that column in the replica's data (one aggregate pass, I1). C7 tightens
    NOT NULL only when it is 0.
    """
    w = write_cat.select("table_name", "column_name", *[F.col(c).alias("w_" + c) for c in
                         ("ordinal", "data_type", "is_nullable", "column_default", "is_key")])
    r = read_cat.select("table_name", "column_name", *[F.col(c).alias("r_" + c) for c in
                        ("data_type", "is_nullable", "column_default")])
    j = w.join(r, ["table_name", "column_name"], "full_outer")
    wd = normalise_expression(F.col("w_column_default"))
    rd = normalise_expression(F.col("r_column_default"))
    both = F.col("w_data_type").isNotNull() & F.col("r_data_type").isNotNull()
    changes = F.array(
        F.when(F.col("r_data_type").isNull(), F.lit("add")),
        F.when(F.col("w_data_type").isNull(), F.lit("drop")),
        F.when(both & (F.col("w_data_type") != F.col("r_data_type")),
               F.when(F.col("w_is_key"), F.lit("retype_key")).otherwise(F.lit("retype"))),
        F.when(both & ~wd.eqNullSafe(rd), F.lit("redefault")),
        F.when(both & F.col("w_is_nullable") & ~F.col("r_is_nullable"), F.lit("relax_null")),
        F.when(both & ~F.col("w_is_nullable") & F.col("r_is_nullable"), F.lit("tighten_null")),
    )
    present = F.filter(changes, lambda x: x.isNotNull())
    listed = F.when(F.size(present) == 0, F.array(F.lit("same"))).otherwise(present)
    out = j.select("table_name", "column_name",
                   F.col("w_data_type").alias("write_type"), F.col("r_data_type").alias("read_type"),
                   F.explode(listed).alias("change"))
    if read_data is None:
        return out
    from .integrity import null_counts
    nulls = null_counts(read_data, read_data.columns).withColumnRenamed("n_nulls", "read_nulls")
    return out.join(nulls, "column_name", "left")


def table_set_drift(write_tables: DataFrame, read_tables: DataFrame, name: str = "table_name",
                    exclude: tuple[str, ...] = ("migrations",)) -> DataFrame:
    """Tables to create (write only) and drop (read only); excluded names ignored.

    One full outer join on the name (an anti join each way would be pushed into
    the branches of a union of catalog literals and lose its join key)."""
    keep = ~F.col(name).isin(*exclude) if exclude else F.lit(True)
    w = write_tables.select(name).filter(keep).distinct().withColumn("_w", F.lit(True))
    r = read_tables.select(name).filter(keep).distinct().withColumn("_r", F.lit(True))
    j = w.join(r, name, "full_outer")
    action = F.when(F.col("_r").isNull(), F.lit("create")).when(F.col("_w").isNull(), F.lit("drop"))
    return j.select(name, action.alias("action")).filter(F.col("action").isNotNull())


def _default_expr(default: str | None, dtype: T.DataType) -> Column:
    if default is None:
        return F.lit(None).cast(dtype)
    return F.expr(default).cast(dtype)


def align(read: DataFrame, target: T.StructType, defaults: dict | None = None,
          strict: bool = True) -> DataFrame:
    """C3 (drop), C4 (add with default) and C5 (retype, F12 cast) in one ``select``.

    Obsolete columns are dropped, missing ones added with their default,
    differing types cast in place (``strict``: ANSI cast, a bad value fails the
    job like the reference's ALTER; otherwise ``try_cast`` leaves NULL, and a pair of
    types without any cast leaves the column NULL, to be refilled by the copy).
    """
    defaults = defaults or {}
    have = {f.name: f.dataType for f in read.schema.fields}
    cols = []
    for f in target.fields:
        if f.name not in have:
            cols.append(_default_expr(defaults.get(f.name), f.dataType).alias(f.name))
        elif have[f.name] != f.dataType:
            c = F.col(f.name)
            if strict:
                cols.append(c.cast(f.dataType).alias(f.name))
            else:
                cols.append((c.try_cast(f.dataType) if castable(read, f.name, f.dataType) else F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return read.select(*cols)


def castable(df: DataFrame, column: str, dtype: T.DataType) -> bool:
    """C5 type level: whether Spark accepts the cast at all (analysis only, no job).

    The expected analysis error of an impossible cast is caught; PySpark's
    query-context logger is muted meanwhile so it is not reported as an error."""
    import logging
    log = logging.getLogger("DataFrameQueryContextLogger")
    was = log.disabled
    log.disabled = True
    try:
        df.select(F.col(column).try_cast(dtype)).schema
        return True
    except Exception:  # noqa: BLE001 - AnalysisException on an impossible cast
        return False
    finally:
        log.disabled = was


def retype_report(df: DataFrame, targets: dict[str, T.DataType]) -> DataFrame:
    """C5 value level: per column, how many non-null values fail the cast.

    Uncastable type pairs are reported as ``castable = false`` (the reference drops
    and recreates such a column, refilled by the copy).  All columns in one pass.
    """
    aggs, meta = [], []
    for i, (c, t) in enumerate(targets.items()):
        ok = castable(df, c, t)
        meta.append((c, df.schema[c].dataType.simpleString(), t.simpleString(), ok))
        bad = F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() if ok else F.col(c).isNotNull()
        aggs.append(F.count_if(bad).cast("bigint").alias(f"_b{i}"))
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(ft).alias("from_type"), F.lit(tt).alias("to_type"),
                      F.lit(ok).alias("castable"), F.col("_n").alias("n_rows"), F.col(f"_b{i}").alias("n_failed"))
             for i, (c, ft, tt, ok) in enumerate(meta)]
    return counts.select(F.explode(F.array(*parts)).alias("_r")).select("_r.*")


def enum_domain_drift(write_values: DataFrame, read_values: DataFrame, col: str) -> DataFrame:
    """Labels of the write domain missing from the read domain.

    Each domain is the distinct values of the column (partial aggregate), and
    the difference an anti join — no domain is collected into one array.
    """
    w = write_values.select(F.col(col).alias("label")).filter(F.col("label").isNotNull()).distinct()
    r = read_values.select(F.col(col).alias("label")).distinct()
    return w.join(r, "label", "left_anti")
