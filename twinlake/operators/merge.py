"""Row-change operators over immutable snapshots.

Each operator returns the *new* read table as a plan over the old one; nothing is
modified in place.  Persist the result with ``sources.tables.publish_snapshot``
(a new version directory), never by overwriting the path being read.  Keys are
matched by joins on the key columns; key sets are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import spread


def _keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """S2 key-only scan: Parquet reads just the key columns."""
    return df.select(*keys)


def upsert(read: DataFrame, write: DataFrame, keys: list[str]) -> DataFrame:
    """M1: insert new keys, overwrite all non-key columns of existing ones."""
    kept = read.join(_keys(write, keys), keys, "left_anti")
    return kept.unionByName(write.select(*read.columns))


def insert_if_absent(read: DataFrame, write: DataFrame, keys: list[str]) -> DataFrame:
    """M2: all-key tables — ``ON CONFLICT DO NOTHING``."""
    new = write.join(_keys(read, keys), keys, "left_anti")
    return read.unionByName(new.select(*read.columns))


def delete_orphans(read: DataFrame, write: DataFrame, keys: list[str]) -> DataFrame:
    """M3/M4: keep read rows whose key tuple still exists in write; an empty write
    side therefore empties the read side (M5)."""
    return spread(read, keys).join(_keys(write, keys), keys, "left_semi")


def replace(write: DataFrame, read_columns: list[str] | None = None) -> DataFrame:
    """M6: tables without a key are replaced wholesale (publish the source as is)."""
    return write if read_columns is None else write.select(*read_columns)


def conflict_holders(write: DataFrame, read: DataFrame, keys: list[str], unique: list[str]) -> DataFrame:
    """M7: write rows whose unique value is held by a *different* key on the read side.

    The read side is first reduced to one row per unique value (smallest holder
    key and holder count), so a value held by many rows never fans out into pairs.
    NULL unique values never clash.  A composite key is compared as a struct and
    reported as ``write_key``/``read_key`` structs.
    """
    if len(keys) > 1:
        return _conflict_holders_composite(write, read, keys, unique)
    k = keys[0]
    r = (read.filter(F.expr(" AND ".join(f"`{u}` IS NOT NULL" for u in unique)))
         .groupBy(*unique)
         .agg(F.min(k).alias("_min_holder"), F.max(k).alias("_max_holder"),
              F.count(F.lit(1)).alias("n_holders")))
    j = write.select(k, *unique).join(r, unique, "inner")
    clash = (F.col("_min_holder") != F.col(k)) | (F.col("_max_holder") != F.col(k))
    holder = F.when(F.col("_min_holder") != F.col(k), F.col("_min_holder")).otherwise(F.col("_max_holder"))
    return j.filter(clash).select(F.col(k).alias("write_key"), *unique,
                                  holder.alias("read_key"), "n_holders")


def _conflict_holders_composite(write: DataFrame, read: DataFrame, keys: list[str], unique: list[str]) -> DataFrame:
    nn = F.expr(" AND ".join(f"`{u}` IS NOT NULL" for u in unique))
    r = (read.filter(nn).groupBy(*unique)
         .agg(F.min(F.struct(*keys)).alias("_min_holder"), F.max(F.struct(*keys)).alias("_max_holder"),
              F.count(F.lit(1)).alias("n_holders")))
    j = write.select(F.struct(*keys).alias("write_key"), *unique).join(r, unique, "inner")
    clash = (F.col("_min_holder") != F.col("write_key")) | (F.col("_max_holder") != F.col("write_key"))
    holder = F.when(F.col("_min_holder") != F.col("write_key"), F.col("_min_holder")).otherwise(F.col("_max_holder"))
    return j.filter(clash).select("write_key", *unique, holder.alias("read_key"), "n_holders")


def upsert_with_fallback(read: DataFrame, write: DataFrame, keys: list[str], unique: list[str]):
    """M7 incremental form: upsert, and if the result breaks a unique constraint,
    replace the table from write.  Returns (new_read, mode) with mode
    'upsert' or 'replaced' (one small aggregate job decides)."""
    merged = upsert(read, write, keys)
    dup = (merged.filter(F.expr(" AND ".join(f"`{u}` IS NOT NULL" for u in unique)))
           .groupBy(*unique).count().filter("count > 1").limit(1).count())
    return (replace(write, read.columns), "replaced") if dup else (merged, "upsert")


def sync_rows(read: DataFrame, write: DataFrame, ids: DataFrame, keys: list[str]):
    """M8: upsert the write rows of the requested ids.  Ids absent from write are
    returned separately (the reference warns and skips them).  Returns (new_read, missing)."""
    req = spread(ids.select(*keys), keys).distinct()
    rows = spread(write, keys).join(req, keys, "left_semi")
    missing = req.join(_keys(write, keys), keys, "left_anti")
    return upsert(spread(read, keys), rows, keys), missing


def sync_children(read: DataFrame, write: DataFrame, parents: DataFrame, fk: str, parent_key: str) -> DataFrame:
    """M9: replace the children of the given parents with the write side's
    (P10 filter by FK value, as a join to the parent-id set)."""
    p = parents.select(F.col(parent_key).alias(fk)).distinct()
    keep = read.join(p, fk, "left_anti")
    fresh = write.join(p, fk, "left_semi").select(*read.columns)
    return keep.unionByName(fresh)


def delete_by_id(read: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Remove the requested keys."""
    return read.join(ids.select(*keys), keys, "left_anti")


def cascade_delete(child: DataFrame, deleted_parents: DataFrame, fk: str, parent_key: str) -> DataFrame:
    """Rows referencing a deleted parent go with it (ON DELETE CASCADE)."""
    gone = deleted_parents.select(F.col(parent_key).alias(fk))
    return child.join(gone, fk, "left_anti")


def key_type_changed(write: DataFrame, read: DataFrame, keys: list[str]) -> bool:
    """Compare key column types from the schemas (no job)."""
    wt = {f.name: f.dataType for f in write.schema.fields}
    rt = {f.name: f.dataType for f in read.schema.fields}
    return any(k not in rt or wt[k] != rt[k] for k in keys)


def rebuild_on_key_type_change(read: DataFrame, write: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """A key type change rebuilds the table from write (replace); otherwise
    the read side is kept for the normal keyed sync.  Returns (table, rebuilt)."""
    if key_type_changed(write, read, keys):
        return replace(write), True
    return read, False


def apply_changes(read: DataFrame, changes: DataFrame, keys: list[str], seq: str = "seq",
                  op: str = "op", row: str = "row") -> DataFrame:
    """T6 (batch core): fold a change log into the table.

    The last change per key wins (``max_by`` on the sequence — a partial
    aggregate, so a hot key is combined map-side); ``delete`` removes the key,
    ``upsert`` replaces the row.
    """
    last = (changes.groupBy(*keys)
            .agg(F.max_by(F.struct(F.col(op).alias("op"), F.col(row).alias("row")), F.col(seq)).alias("_last")))
    kept = read.join(last.select(*keys), keys, "left_anti")
    ups = last.filter(F.col("_last.op") == "upsert").select("_last.row.*").select(*read.columns)
    return kept.unionByName(ups)
