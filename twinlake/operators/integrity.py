"""Integrity and constraint scans.

Every scan is one pass over the table: per-column counts are a single
aggregate, per-row violations a single projection + explode, key checks one
partial-aggregated ``groupBy``.  FK checks join the child to the *distinct*
parent keys, so a hot foreign-key value is never multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ForeignKey


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column_name, n_nulls)`` for every column (P7 ``IS NULL``), in one aggregate."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in cols])
    return agg.unpivot([], cols, "column_name", "n_nulls")


class NotNullViolation(ValueError):
    pass


def not_null_gate(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Tighten only when no NULL is present; raise with the counts otherwise."""
    counts = {r["column_name"]: r["n_nulls"] for r in null_counts(df, cols).collect()}  # one row per column
    bad = {c: n for c, n in counts.items() if n}
    if bad:
        raise NotNullViolation(f"NULL values block NOT NULL: {bad}")
    return counts


def unique_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Key tuples held by more than one row; tuples with a NULL never clash."""
    nn = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return (df.filter(nn).groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def primary_key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unique + not null over the key; ``keys + violation + n_rows``.

    Duplicates are reported per key tuple; NULL keys as one row per key column
    holding NULLs (key values NULL).
    """
    dups = unique_violations(df, keys).withColumn("violation", F.lit("duplicate"))
    nulls = (null_counts(df, keys).filter(F.col("n_nulls") > 0)
             .select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys],
                     F.concat(F.lit("null:"), F.col("column_name")).alias("violation"),
                     F.col("n_nulls").alias("n_rows")))
    return dups.select(*keys, "violation", "n_rows").unionByName(nulls)


def key_profile(sides: dict[str, DataFrame], keys: list[str]) -> dict[str, dict[str, bool]]:
    """I7 for several tables at once: per side, whether the key has duplicates or NULLs.

    One job over the key columns only: the sides' keys are tagged and unioned,
    counted per (side, key) with a partial aggregate, then reduced to one row per
    side — so at most ``len(sides)`` rows reach the driver.
    """
    parts = [df.select(F.lit(name).alias("_side"), *keys) for name, df in sides.items()]
    tagged = reduce(lambda a, b: a.unionByName(b), parts)
    per_key = tagged.groupBy("_side", *keys).agg(F.count(F.lit(1)).alias("_n"))
    prof = per_key.groupBy("_side").agg(
        (F.max("_n") > 1).alias("duplicate"),
        F.max(_any_null(keys).cast("int")).alias("_null"))
    out = {name: {"duplicate": False, "null": False} for name in sides}
    for r in prof.collect():  # one row per side
        out[r["_side"]] = {"duplicate": bool(r["duplicate"]), "null": bool(r["_null"])}
    return out


def length_violations(df: DataFrame, limits: dict[str, int], key: list[str]) -> DataFrame:
    """``key + column_name + length + max_length`` for values longer than the
    declared varchar length; all columns checked in one pass."""
    cands = [F.when(F.length(c) > n, F.struct(F.lit(c).alias("column_name"),
                                              F.length(c).cast("bigint").alias("length"),
                                              F.lit(n).cast("bigint").alias("max_length")))
             for c, n in limits.items()]
    arr = F.filter(F.array(*cands), lambda x: x.isNotNull())
    return df.select(*key, F.explode(arr).alias("_v")).select(*key, "_v.*")


def _any_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def _parent_flags(child: DataFrame, parent: DataFrame, fk: ForeignKey, flag: str) -> DataFrame:
    pk = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(fk.parent_columns)]).distinct() \
               .withColumn(flag, F.lit(True))
    cond = reduce(lambda a, b: a & b, [child[c] == pk[f"_p{i}"] for i, c in enumerate(fk.columns)])
    j = child.join(pk, cond, "left")
    return j.drop(*[f"_p{i}" for i in range(len(fk.columns))])


def fk_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Child rows with every FK column non-null (P6) and no parent (MATCH SIMPLE)."""
    nn = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fk.columns])
    pk = parent.select(*[F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns)])
    return child.filter(nn).join(pk, list(fk.columns), "left_anti")


def fk_cleanup(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Keep rows with a NULL in the FK or an existing parent.  One scan of the
    child, one join to the distinct parent keys (no union of two scans)."""
    j = _parent_flags(child, parent, fk, "_has_parent")
    return j.filter(_any_null(list(fk.columns)) | F.col("_has_parent").isNotNull()).drop("_has_parent")


def _fk_value(fk: ForeignKey) -> Column:
    """The reference as reported: the value of a single column, a JSON object of all columns of a composite key."""
    return F.col(fk.columns[0]) if len(fk.columns) == 1 else F.to_json(F.struct(*fk.columns))


def fk_orphan_report(child: DataFrame, parents: dict[str, DataFrame], fks: list[ForeignKey],
                     key: list[str]) -> DataFrame:
    """I4: which rows break which constraint; one anti join per FK, unioned."""
    parts = [fk_orphans(child, parents[fk.parent], fk)
             .select(F.lit(fk.name).alias("constraint_name"), *key, _fk_value(fk).alias("fk_value"))
             for fk in sorted(fks, key=lambda f: f.name)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def self_reference_cleanup(df: DataFrame, fk: ForeignKey, key: str, materialize: bool = True) -> DataFrame:
    """I5 for a single-column self-reference (e.g. ``boss -> id``) in O(log depth) rounds.

    Repeatedly deleting first-level orphans until nothing changes needs one round
    per level of a dangling chain.  Pointer jumping resolves every row in
    ``ceil(log2(depth)) + 1`` rounds instead: each pending row follows its pointer
    to that row's pointer; it is *kept* when its chain reaches a NULL reference,
    *removed* when the chain hits a missing id.  Rows still pending after a round
    that resolved nothing lead into a cycle of existing rows and are kept (the
    same set the delete-to-fixpoint loop leaves).  Each round is one join on the
    pointer, and its result is checkpointed so the lineage stays one round deep.
    """
    (c,), (pc,) = fk.columns, fk.parent_columns
    assert pc == key, "self_reference_cleanup expects the FK to reference the key column"
    ids = df.select(F.col(key).alias("_id")).distinct()
    node = (df.select(F.col(key).alias("_n"), F.col(c).alias("_ptr"))
            .join(ids.withColumn("_hit", F.lit(True)), F.col("_ptr") == F.col("_id"), "left")
            .select("_n", "_ptr",
                    F.when(F.col("_ptr").isNull(), F.lit(1))         # kept: chain ends in NULL
                     .when(F.col("_hit").isNull(), F.lit(0))          # removed: dangling
                     .otherwise(F.lit(None).cast("int")).alias("_st")))
    if materialize:
        node = node.checkpoint(eager=True)
    pending = node.filter(F.col("_st").isNull()).count()
    while pending:
        look = node.select(F.col("_n").alias("_m"), F.col("_ptr").alias("_ptr2"), F.col("_st").alias("_st2"))
        nxt = (node.join(look, F.col("_ptr") == F.col("_m"), "left")
               .select("_n",
                       F.when(F.col("_st").isNull() & F.col("_st2").isNull(), F.col("_ptr2"))
                        .otherwise(F.col("_ptr")).alias("_ptr"),
                       F.coalesce(F.col("_st"), F.col("_st2")).alias("_st")))
        node = nxt.checkpoint(eager=True)  # always: each round reads the last one twice
        left = node.filter(F.col("_st").isNull()).count()
        if left == pending:      # no row resolved this round: the rest lead into cycles
            break
        pending = left
    keep = node.filter(F.coalesce(F.col("_st"), F.lit(1)) == 1).select(F.col("_n").alias("_keep"))
    return df.join(keep, df[key] == F.col("_keep"), "left_semi")


def fk_cleanup_chain(tables: dict[str, DataFrame], fks: dict[str, list[ForeignKey]],
                     materialize: bool = True, keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Clean FK orphans parents-first, so a parent's removed rows make its
    children's references dangle before the children are checked.

    ``fks`` maps child table -> constraints.  Tables are visited in topological
    order.  A single-column self-reference to the table's key (``keys`` maps table
    -> key column) uses ``self_reference_cleanup`` (O(log depth) rounds); any other
    self-reference is re-applied until no row is removed.
    Each cleaned table is checkpointed (reliable checkpoint in the session's
    checkpoint dir) so deep chains do not grow one giant lineage.  Tables that
    reference each other have no such order: the whole pass is then repeated, from
    checkpoint to checkpoint, until it removes no row.
    """
    order, cyclic = _topological(tables, fks)
    out = _clean_pass(dict(tables), order, fks, materialize or cyclic, keys)
    if cyclic:
        sizes = {n: out[n].count() for n in cyclic}
        while True:
            out = _clean_pass(out, order, fks, True, keys)
            left = {n: out[n].count() for n in cyclic}
            if left == sizes:
                break
            sizes = left
    return out


def _clean_pass(out: dict[str, DataFrame], order: list[str], fks: dict[str, list[ForeignKey]], materialize: bool,
                keys: dict[str, str] | None) -> dict[str, DataFrame]:
    """One pass over the tables in order."""
    for name in order:
        df = out[name]
        for fk in sorted(fks.get(name, []), key=lambda f: f.name):
            if fk.parent == name and len(fk.columns) == 1 and (keys or {}).get(name) == fk.parent_columns[0]:
                df = self_reference_cleanup(df, fk, fk.parent_columns[0])  # iterative: always checkpointed
            elif fk.parent == name:
                while True:
                    before = df.count()
                    df = fk_cleanup(df, df, fk).checkpoint(eager=True)  # always: the plan would double each round
                    if df.count() == before:
                        break
            else:
                df = fk_cleanup(df, out[fk.parent], fk)
        if materialize and fks.get(name):
            df = df.checkpoint(eager=True)
        out[name] = df
    return out


def _topological(tables: dict[str, DataFrame], fks: dict[str, list[ForeignKey]]) -> tuple[list[str], list[str]]:
    """Tables with parents first, and the tables on reference cycles (a cycle is cut at its last table by name)."""
    deps = {t: {fk.parent for fk in fks.get(t, []) if fk.parent != t and fk.parent in tables} for t in tables}
    order, seen, cyclic = [], set(), set()

    def visit(t, stack=()):
        if t in seen:
            return
        if t in stack:
            cyclic.update(stack[stack.index(t):])
            return
        for p in sorted(deps[t]):
            visit(p, stack + (t,))
        seen.add(t)
        order.append(t)

    for t in sorted(tables):
        visit(t)
    return order, sorted(cyclic)
