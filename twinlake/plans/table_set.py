"""Synchronise a whole set of tables as one commit.

The read side is a set of snapshot versions named by a manifest (the snapshot table ``_set``: table, version).  A sync

1. lists the tables of both sides (the write root's Parquet tables, the newest manifest) and plans what to create,
   drop and keep;
2. writes one new version a table, in one job that also classifies every row against the old version; inserts,
   updates, deletes, equal rows, nulls in NOT NULL columns and over-long values are counted by ``DataFrame.observe``
   in that job, so nothing is counted before or after;
3. compares enum domains, checks unique columns and cleans foreign keys over the loaded tables, parents first;
4. publishes the manifest.  That is the only commit: until then readers see the old set, whatever has been written.

A table that did not change keeps its old version.  ``vacuum`` drops versions that the newest manifests do not name,
with those of dropped tables and of syncs that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import drift as C
from ..operators import integrity as I
from ..operators import merge as M
from ..sources.inventory import DEFAULT_EXCLUDE, table_names
from ..sources.tables import TableSpec, _fs, publish_snapshot, read_snapshot, snapshot_versions
from .sync import REPORT_SCHEMA, KeyViolation, _schema_drift_rows

MANIFEST = "_set"
ACTIONS = ("insert", "update", "delete", "same")


class ConstraintViolation(ValueError):
    pass


# -- the read side ------------------------------------------------------------------

def set_versions(spark: SparkSession, read_root: str) -> list[int]:
    return snapshot_versions(spark, read_root, MANIFEST)


def manifest(spark: SparkSession, read_root: str, version: int | None = None) -> dict[str, int]:
    """Tables of a set version (the newest by default) and their snapshot versions; empty before the first sync."""
    if not set_versions(spark, read_root):
        return {}
    return {r["table_name"]: r["version"] for r in read_snapshot(spark, read_root, MANIFEST, version).collect()}  # a row a table


def read_table(spark: SparkSession, read_root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as the set version has it."""
    return read_snapshot(spark, read_root, name, manifest(spark, read_root, version)[name])


def publish_set(spark: SparkSession, read_root: str, versions: dict[str, int]) -> int:
    rows = spark.createDataFrame(sorted(versions.items()), "table_name string, version long")
    return publish_snapshot(rows.coalesce(1), read_root, MANIFEST)


def vacuum(spark: SparkSession, read_root: str, keep: int = 2) -> int:
    """Drop table versions that none of the newest ``keep`` manifests names; their number.  Not beside a running sync."""
    sets = set_versions(spark, read_root)
    named = {(t, v) for s in sets[-keep:] for t, v in manifest(spark, read_root, s).items()}
    fs, root = _fs(spark, read_root)
    dropped = 0
    for d in [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]:
        name = d.getName()
        kept = {v for t, v in named if t == name} if name != MANIFEST else set(sets[-keep:])
        versions = snapshot_versions(spark, read_root, name, committed=False)
        stale = [v for v in versions if v not in kept]
        dropped += len(stale)
        for p in [d] if versions and len(stale) == len(versions) else [_fs(spark, f"{read_root.rstrip('/')}/{name}/v={v}")[1] for v in stale]:
            fs.delete(p, True)
    return dropped


# -- one table -----------------------------------------------------------------------

def _checks(spec: TableSpec) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in spec.not_null] + [
        F.count_if(F.length(c) > n).alias(f"long:{c}") for c, n in spec.lengths.items()]


def _load(spec: TableSpec, write: DataFrame, old: DataFrame | None, read_root: str) -> tuple[int, dict]:
    """Write the table's next version; the version and the counts that the write job observed."""
    keys, cols, seen = list(spec.keys), write.columns, Observation()
    if old is None or not keys or M.key_type_changed(write, old, keys):
        new = write.distinct() if spec.all_key(write) else write
        new = new.observe(seen, F.count(F.lit(1)).alias("rows"), *_checks(spec))
        return publish_snapshot(new, read_root, spec.name), dict(seen.get)
    rr = C.align(old, write.schema, strict=False)
    if spec.all_key(write):  # a set of keys, null parts included
        sides = write.distinct().withColumn("_s", F.lit(1)).unionByName(rr.distinct().withColumn("_s", F.lit(2)))
        both = sides.groupBy(*cols).agg(F.sum("_s").alias("_s"))
        both = both.select(*cols, F.when(F.col("_s") == 1, "insert").when(F.col("_s") == 2, "delete").otherwise("same").alias("_action"))
    else:
        values = [c for c in cols if c not in keys]
        w = write.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("_w"))
        r = rr.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("_r"))
        action = (F.when(F.col("_r").isNull(), "insert").when(F.col("_w").isNull(), "delete")
                  .when(F.col("_w").eqNullSafe(F.col("_r")), "same").otherwise("update"))
        both = w.join(r, keys, "full_outer").select(*[F.col(c) if c in keys else F.col("_w")[c].alias(c) for c in cols], action.alias("_action"))
    counted = [F.count_if(F.col("_action") == a).alias(a) for a in ACTIONS]
    there = F.col("_action") != "delete"
    checks = [F.count_if(there & F.col(c).isNull()).alias(f"null:{c}") for c in spec.not_null] + [
        F.count_if(there & (F.length(c) > n)).alias(f"long:{c}") for c, n in spec.lengths.items()]
    new = both.observe(seen, *counted, *checks).filter(there).drop("_action")
    return publish_snapshot(new, read_root, spec.name), dict(seen.get)


def _drop_version(spark: SparkSession, read_root: str, name: str, version: int) -> None:
    fs, p = _fs(spark, f"{read_root.rstrip('/')}/{name}/v={version}")
    fs.delete(p, True)


# -- the set --------------------------------------------------------------------------

def sync_table_set(spark: SparkSession, write_root: str, read_root: str, specs: dict[str, TableSpec] | None = None,
                   exclude: tuple[str, ...] = DEFAULT_EXCLUDE, enums: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Make the read set equal to the write root's tables; the report (table_name, action, n_rows).

    Tables without a spec have no key and are replaced.  Actions: create, drop, insert, update, delete, same, replace,
    rebuild, column_add, column_drop, column_retype, enum_add, enum_drop, fk_removed, unchanged (tables that kept their version).
    A null in a NOT NULL column, an over-long value, a broken key or a clash in a unique column of the write side raises before the commit.
    """
    specs, report = specs or {}, []
    names = table_names(spark, write_root, exclude)
    old = {t: v for t, v in manifest(spark, read_root).items() if t not in exclude}
    versions: dict[str, int] = {}
    rows_of: dict[str, int] = {}
    for name in sorted(set(old) - set(names)):
        report.append((name, "drop", 0))
    for name in names:
        spec = specs.get(name, TableSpec(name))
        write = spark.read.parquet(f"{write_root.rstrip('/')}/{name}.parquet")
        before = read_snapshot(spark, read_root, name, old[name]) if name in old else None
        if spec.has_key and not spec.all_key(write):
            prof = I.key_profile({"write": write}, list(spec.keys))["write"]
            if prof["duplicate"] or prof["null"]:
                raise KeyViolation(f"{name}: key {list(spec.keys)} of the write side is not unique/not null")
        for u in spec.uniques:
            if I.unique_violations(write.select(*u).dropna(), list(u)).limit(1).count():
                raise ConstraintViolation(f"{name}: unique columns {list(u)} clash")
        drift = [] if before is None else _schema_drift_rows(name, write, before)
        for c in (enums or {}).get(name, ()):
            if before is not None and c in before.columns:
                for kind, a, b in (("enum_add", write, before), ("enum_drop", before, write)):
                    n = C.enum_domain_drift(a, b, c).agg(F.count(F.lit(1)).alias("n")).first()["n"]  # one row
                    report += [(name, kind, n)] if n else []
        version, seen = _load(spec, write, before, read_root)
        bad = {k: n for k, n in seen.items() if ":" in k and n}
        if bad:
            raise ConstraintViolation(f"{name}: {bad}")
        report += drift
        if "rows" in seen:
            report.append((name, "create" if before is None else "rebuild" if spec.has_key else "replace", seen["rows"]))
            rows_of[name] = seen["rows"]
        else:
            report += [(name, a, seen[a]) for a in ACTIONS if seen[a]]
            rows_of[name] = seen["insert"] + seen["update"] + seen["same"]
            if not drift and rows_of[name] == seen["same"] and not seen["delete"]:
                _drop_version(spark, read_root, name, version)
                version = old[name]
                report.append((name, "unchanged", rows_of[name]))
        versions[name] = version
    fks = {n: [k for k in s.fks if k.parent in versions] for n, s in specs.items() if n in versions and s.fks}
    if any(fks.values()):
        loaded = {n: read_snapshot(spark, read_root, n, v) for n, v in versions.items()}
        keys = {n: s.keys[0] for n, s in specs.items() if len(s.keys) == 1}
        cleaned = I.fk_cleanup_chain(loaded, fks, materialize=False, keys=keys)
        for name in fks:
            seen = Observation()
            version = publish_snapshot(cleaned[name].observe(seen, F.count(F.lit(1)).alias("rows")), read_root, name)
            gone = rows_of[name] - seen.get["rows"]
            if gone:
                versions[name] = version
                report.append((name, "fk_removed", gone))
            else:
                _drop_version(spark, read_root, name, version)
    publish_set(spark, read_root, versions)
    return spark.createDataFrame(report, REPORT_SCHEMA)
