"""Full table-set synchronisation (M12) and its change report.

Per table the order is the reference's: key-type check (rebuild) -> schema
alignment -> diff -> orphans removed -> keyed upsert (or replace when there is no
key); after every table is loaded: NOT NULL gate, FK cleaning parents first, key
high-water marks.  Each table is one or two Spark jobs;
the Python loop only walks table names.  Every new read table is published as a
new snapshot version, so no job ever overwrites the input it is reading.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import diff as D
from ..operators import integrity as I
from ..operators import merge as M
from ..sources.tables import TablePair, publish_snapshot, read_snapshot

REPORT_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("n_rows", T.LongType(), False),
])


class KeyViolation(ValueError):
    pass


@dataclass
class TableResult:
    name: str
    new_read: DataFrame
    report: DataFrame  # (table_name, action, n_rows)


def _schema_drift_rows(name: str, write: DataFrame, read: DataFrame) -> list[tuple]:
    """C2 counts from the two schemas (driver-side metadata, no job)."""
    wt = {f.name: f.dataType for f in write.schema.fields}
    rt = {f.name: f.dataType for f in read.schema.fields}
    counts = {"column_add": sum(1 for c in wt if c not in rt),
              "column_drop": sum(1 for c in rt if c not in wt),
              "column_retype": sum(1 for c in wt if c in rt and wt[c] != rt[c])}
    return [(name, k, v) for k, v in counts.items() if v]


def sync_table(pair: TablePair) -> TableResult:
    """Plan the new read side of one table and its per-action counts.

    Order per table: key-type drift rebuilds the table (M13); otherwise the read
    side is aligned to the write schema (C3-C5, lenient casts: the copy refills
    every value anyway) and diffed against write (D1) for the report; orphans are
    deleted (M3/M4) and write rows upserted (M1) or inserted if absent (M2).
    Tables without a key are replaced (M6).
    """
    from ..operators.drift import align
    spec, w, r = pair.spec, pair.write, pair.read
    spark = w.sparkSession
    cols = w.columns
    drift = _schema_drift_rows(spec.name, w, r)
    extra = spark.createDataFrame(drift, REPORT_SCHEMA) if drift else None

    def with_drift(report: DataFrame) -> DataFrame:
        return report if extra is None else report.unionByName(extra)

    if not spec.has_key:
        report = w.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(spec.name).alias("table_name"), F.lit("replace").alias("action"), "n_rows")
        return TableResult(spec.name, M.replace(w, cols), with_drift(report))
    keys = list(spec.keys)
    if M.key_type_changed(w, r, keys):
        report = w.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(spec.name).alias("table_name"), F.lit("rebuild").alias("action"), "n_rows")
        return TableResult(spec.name, M.replace(w, cols), with_drift(report))
    rr = align(r, w.schema, strict=False)
    if spec.all_key(w):
        # every column is key: a duplicate key is an identical copy and the table is a
        # set (M2, DO NOTHING), so copies collapse in a map-side distinct and no
        # separate key check is needed
        wd, rd = w.distinct(), rr.distinct()
        diff = D.row_diff(wd, rd, keys)
        report = D.diff_counts(diff).select(F.lit(spec.name).alias("table_name"), "action", "n_rows")
        # orphans go and every write row is set, so the new replica is the write side itself
        return TableResult(spec.name, M.replace(wd, cols), with_drift(report))
    # I7 before any merge, both sides in one key-only job: a broken key on the
    # source side is an error; duplicate keys on the replica would make the keyed
    # diff pair up copies, so the replica is replaced from write instead (M7 fallback).
    prof = I.key_profile({"write": w, "read": rr}, keys)
    if prof["write"]["duplicate"] or prof["write"]["null"]:
        raise KeyViolation(f"{spec.name}: key {keys} of the write side is not unique/not null")
    if prof["read"]["duplicate"]:
        report = w.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(spec.name).alias("table_name"), F.lit("replace_duplicate_keys").alias("action"), "n_rows")
        return TableResult(spec.name, M.replace(w, cols), with_drift(report))
    diff = D.row_diff(w, rr, keys)
    report = D.diff_counts(diff).select(F.lit(spec.name).alias("table_name"), "action", "n_rows")
    # deleting orphans and upserting every write row leaves exactly the write side: no second join
    return TableResult(spec.name, M.replace(w, cols), with_drift(report))


def sync_all(spark: SparkSession, pairs: list[TablePair], read_root: str,
             exclude: tuple[str, ...] = ("migrations",)) -> tuple[DataFrame, dict[str, int]]:
    """Synchronise every pair not excluded; returns (report DataFrame, published versions).

    The report is materialised (small: a few rows per table) before the new
    snapshots are published, because it reads the old read side.
    """
    results = [sync_table(p) for p in pairs if p.spec.name not in exclude]
    report_rows = []
    for res in results:
        report_rows.extend(tuple(x) for x in res.report.collect())  # <= 7 rows per table
    versions = {}
    for res in results:
        versions[res.name] = publish_snapshot(res.new_read, read_root, res.name)
    # NOT NULL gate and FK cleaning run after every table is loaded
    specs = {p.spec.name: p.spec for p in pairs if p.spec.name not in exclude}
    loaded = {n: read_snapshot(spark, read_root, n, v) for n, v in versions.items()}
    for name, spec in specs.items():
        if spec.not_null:
            I.not_null_gate(loaded[name], list(spec.not_null))
    fks = {n: list(s.fks) for n, s in specs.items() if s.fks}
    if fks:
        keys = {n: s.keys[0] for n, s in specs.items() if len(s.keys) == 1}
        cleaned = I.fk_cleanup_chain(loaded, fks, materialize=False, keys=keys)
        for name in fks:
            before = loaded[name].count()
            versions[name] = publish_snapshot(cleaned[name], read_root, name)
            after = read_snapshot(spark, read_root, name, versions[name]).count()
            report_rows.append((name, "fk_removed", before - after))
    # A3: key high-water marks of single numeric keys, after the load
    for name, spec in specs.items():
        if len(spec.keys) == 1:
            k = spec.keys[0]
            snap = read_snapshot(spark, read_root, name, versions[name])
            if isinstance(snap.schema[k].dataType, (T.IntegerType, T.LongType, T.ShortType)):
                from ..operators.listing import high_water_mark
                nxt = high_water_mark(snap, k).first()["next_value"]  # one row
                report_rows.append((name, "next_key", int(nxt)))
    return spark.createDataFrame(report_rows, REPORT_SCHEMA), versions


def sync_state(spark: SparkSession, pairs: list[TablePair], read_root: str,
               versions: dict[str, int]) -> DataFrame:
    """Per table after a sync: rows published and whether they equal write."""
    parts = []
    for p in pairs:
        if p.spec.name not in versions:
            continue
        snap = read_snapshot(spark, read_root, p.spec.name, versions[p.spec.name])
        snap = snap.select(*p.write.columns)
        n = snap.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("_diff"))
        d = D.signed_row_counts(p.write, snap).agg(F.lit(0).cast("bigint").alias("n_rows"),
                                                   F.count(F.lit(1)).cast("bigint").alias("_diff"))
        counts = n.unionByName(d).agg(F.sum("n_rows").alias("n_rows"), (F.sum("_diff") == 0).alias("is_equal"))
        parts.append(counts.select(F.lit(p.spec.name).alias("table_name"), "n_rows", "is_equal"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
