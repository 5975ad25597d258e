"""Table sources: the driver's Parquet tables, table specs and snapshot storage.

A replica is modelled as two roots of immutable Parquet snapshots, ``write`` (the
source of truth) and ``read`` (the replica).  Nothing is overwritten in place: a
sync writes a new snapshot version and readers resolve the newest committed one,
so a plan that is reading version *n* never sees its input change under it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Lazy accessor for the Parquet tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in DRIVER_TABLES:
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._cache[name]

    def names(self) -> list[str]:
        return list(DRIVER_TABLES)


@dataclass(frozen=True)
class ForeignKey:
    """child columns -> parent table columns (MATCH SIMPLE: any null child column skips the check)."""

    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSpec:
    """What the sync and integrity operators need to know about one table."""

    name: str
    keys: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    fks: tuple[ForeignKey, ...] = ()
    not_null: tuple[str, ...] = ()
    lengths: dict = field(default_factory=dict)

    @property
    def has_key(self) -> bool:
        return len(self.keys) > 0

    def all_key(self, df: DataFrame) -> bool:
        return self.has_key and set(df.columns) == set(self.keys)


@dataclass
class TablePair:
    """One table bound to both sides: ``write`` is the truth, ``read`` the replica."""

    spec: TableSpec
    write: DataFrame
    read: DataFrame


# --------------------------------------------------------------------------
# Snapshot storage: <root>/<table>/v=<n>/ ; current = highest v with _SUCCESS
# --------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def snapshot_versions(spark: SparkSession, root: str, table: str, committed: bool = True) -> list[int]:
    """Versions of a table; by default only committed ones (holding a _SUCCESS marker).
    ``committed=False`` also lists directories left by a failed write."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/{table}")
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if not committed or fs.exists(st.getPath().suffix("/_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def read_snapshot(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    vs = snapshot_versions(spark, root, table)
    if not vs:
        raise FileNotFoundError(f"no committed snapshot of {table} under {root}")
    v = vs[-1] if version is None else version
    return spark.read.parquet(f"{root.rstrip('/')}/{table}/v={v}")


def publish_snapshot(df: DataFrame, root: str, table: str) -> int:
    """Write ``df`` as the next version of ``table``; returns the version number.

    The write goes to a fresh directory, so ``df`` may itself be a plan over the
    current version.  The commit marker makes the version visible atomically.
    """
    spark = df.sparkSession
    vs = snapshot_versions(spark, root, table, committed=False)  # skip dirs of failed writes too
    v = (vs[-1] + 1) if vs else 0
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{table}/v={v}")
    return v


def list_snapshot_tables(spark: SparkSession, root: str) -> list[str]:
    """Table names under a snapshot root that have at least one committed version."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    return sorted(n for n in names if not n.startswith(("_", ".")) and snapshot_versions(spark, root, n))
