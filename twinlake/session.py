"""Session construction and cluster-level settings.

Library code never creates its own session on a cluster: it takes the caller's
``SparkSession``.  ``get_session`` exists for tests, the bench and local runs and
sets the knobs the operators rely on (AQE with skew splitting, UTC, no UI).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package assumes.  AQE re-plans joins from runtime
# sizes (a broadcast happens only when the measured side is under the
# threshold), splits skewed shuffle partitions and coalesces tiny ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.executorEnv.PYTHONWARNINGS": "ignore::FutureWarning",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "twinlake", extra: dict | None = None) -> SparkSession:
    """Local/test session with the package defaults applied."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("TWINLAKE_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints and scratch tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint
    dir).  Library code fails loudly rather than fall back to a machine-local
    folder, which executors on other hosts could not see.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    return d


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Set a temporary checkpoint dir when none is configured, on local masters only: executors on other
    hosts would not see it, so any other master without ``spark.checkpoint.dir`` is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            return checkpoint_dir(spark)
        d = tempfile.mkdtemp(prefix="twinlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return checkpoint_dir(spark).rstrip("/") + "/twinlake-scratch/" + name
