"""Many-to-many expansion, parent-existence checks and positional unnest.

Skew note: a link table may hold one very hot entity.  Every join here keeps the
link table on the side AQE is allowed to split (inner joins, or the streamed side
of semi/anti joins), and existence tests join against *distinct* keys, which a
partial aggregate reduces map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct key tuple of a (possibly huge, possibly skewed) table; partial-aggregated."""
    return df.select(*cols).distinct()


def m2n_expand(left: DataFrame, link: DataFrame, right: DataFrame,
               left_key: str, link_left: str, link_right: str, right_key: str,
               link_cols: tuple[str, ...] = ()) -> DataFrame:
    """J1/J2 in long form: one row per (entity, related row); entities with no
    related row kept once with NULL related columns (the nested array is empty).

    Links whose related row does not exist are dropped (P5, the null-element
    filter on the relation array); the link columns are not part of the output (P4).
    """
    lk = link.select(F.col(link_left).alias("_ll"), F.col(link_right).alias("_lr"),
                     *[F.col(c) for c in link_cols])
    related = lk.join(right, F.col("_lr") == right[right_key], "inner").drop("_lr")
    matched = left.join(related, left[left_key] == F.col("_ll"), "inner").drop("_ll")
    unmatched = left.join(distinct_keys(related, "_ll"), left[left_key] == F.col("_ll"), "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def m2n_nested(long_form: DataFrame, entity_cols: list[str], related_cols: list[str],
               as_name: str, sort_key: str) -> DataFrame:
    """J1 exact reply shape: the related rows nested as a sorted array per entity.

    The array of one entity is collected into one row, so use this on a bounded
    set of entities (a page or a requested id list), as the reference does for a
    single id; bulk consumers should use the long form.
    """
    rel = F.struct(*[F.col(c) for c in [sort_key] + [c for c in related_cols if c != sort_key]])
    return (long_form.groupBy(*entity_cols)
            .agg(F.array_sort(F.collect_list(F.when(F.col(sort_key).isNotNull(), rel))).alias(as_name)))


def require_parents(child: DataFrame, parents: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Child rows whose every (parent, parent_key, child_col) exists (semi joins)."""
    out = child
    for parent, pkey, ccol in parents:
        keys = distinct_keys(parent, pkey).withColumnRenamed(pkey, "_pk")
        out = out.join(keys, out[ccol] == F.col("_pk"), "left_semi")
    return out


def flag_parents(child: DataFrame, parents: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """J3 keeping rejects: add one boolean per parent (left join to distinct keys)."""
    out = child
    for parent, pkey, ccol, flag in parents:
        keys = distinct_keys(parent, pkey).select(F.col(pkey).alias("_pk"), F.lit(True).alias(flag))
        out = out.join(keys, out[ccol] == F.col("_pk"), "left").drop("_pk") \
                 .withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return out


def multi_key_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join on several column pairs at once (one shuffle on the tuple)."""
    cond = None
    for lc, rc in pairs:
        c = left[lc] == right[rc]
        cond = c if cond is None else cond & c
    return left.join(right, cond, how)


def unnest_zip(df: DataFrame, a: str, b: str, keep: list[str],
               ord_name: str = "ordinality") -> DataFrame:
    """``unnest(a, b) WITH ORDINALITY`` — i-th of a paired with i-th of b,
    1-based position; rows whose arrays differ in length are skipped (F16 guard)."""
    guarded = df.filter(F.size(a) == F.size(b))
    z = guarded.select(*keep, F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))))
    return z.select(*keep, (F.col("pos") + 1).cast("bigint").alias(ord_name),
                    F.col("col.a").alias(a + "_elem"), F.col("col.b").alias(b + "_elem"))
