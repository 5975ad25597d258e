"""Run the streaming operators end to end over topic files derived from the tables.

Each ``*_run`` writes the input as time-ordered topic files under the session's
shared checkpoint folder, runs the streaming query with an ``availableNow``
trigger (several micro-batches, so state really carries between batches), and
returns the sink contents as a batch DataFrame.  They back the ``stream_*``
query keys, whose answers must equal the batch forms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.buckets import BucketedTable
from ..sources.tables import _fs, publish_snapshot, read_snapshot
from . import cdc, commands, ordered, replies, topics

#: Least number of files a micro-batch; larger inputs are read in ``BATCHES`` micro-batches, however many files they have.
FILES_PER_BATCH = 2
BATCHES = 8


def _root(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def write_time_chunks(df: DataFrame, path: str, ts: str, chunks: int = 4, key: str | None = None,
                      after: Callable[[], None] | None = None) -> int:
    """Write ``df`` as ``chunks`` successive appends, each covering the next range
    of ``ts`` (a time or a number), so a file stream reads them in that order.
    Only the column's min and max come to the driver.  The input is checkpointed
    once so the chunk writes do not recompute its plan.

    With ``key``, all rows of a key and chunk are in one file, as in a partition of a
    topic.  Files are read in the order of their appends, so a key's rows keep their
    order wherever micro-batches cut a chunk, however many files it has.

    ``after`` is called after each append, e.g. to run a stream over it.

    Returns the length of a chunk in whole seconds, rounded up (0 for numbers): how far
    behind the newest row a row of the same chunk can be, and so the least watermark
    delay that loses none.
    """
    df = (df.repartition(key) if key else df).checkpoint(eager=True)
    b = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()  # one row: the time range
    if b["lo"] is None:
        return 0
    lo, hi = b["lo"], b["hi"]
    step = (hi - lo) / chunks
    cuts = [F.lit(lo + step * i) for i in range(1, chunks)]
    # contiguous half-open ranges, open at both ends: every row lands in exactly one chunk
    for i in range(chunks):
        cond = F.lit(True)
        if i > 0:
            cond = cond & (F.col(ts) >= cuts[i - 1])
        if i < chunks - 1:
            cond = cond & (F.col(ts) < cuts[i])
        df.filter(cond).write.mode("append").parquet(path)
        if after:
            after()
    return int(step.total_seconds()) + 1 if hasattr(step, "total_seconds") else 0


def files_per_batch(spark: SparkSession, *paths: str, batches: int = BATCHES) -> int:
    """Files a micro-batch so that the topics' files make ``batches`` of them at most, but not fewer than ``FILES_PER_BATCH``."""
    most = 0
    for path in paths:
        fs, p = _fs(spark, path)
        files = [s for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")] if fs.exists(p) else []
        most = max(most, len(files))
    return max(FILES_PER_BATCH, -(-most // batches))


def _drain(stream: DataFrame, sink: str, ckpt: str):
    """Run a stream to the end of its input; the finished query."""
    q = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def command_records(cmd: DataFrame) -> DataFrame:
    """FX-CMD rows as author.* topic records (absent fields left out of the payload)."""
    return topics.to_records(
        cmd, F.concat(F.lit("author."), F.col("op")), F.col("id"),
        {"value": (F.col("has_value"), F.col("value")), "props": (F.col("has_props"), F.col("props"))},
        F.col("ts"), F.col("event_id"))


def _applied_stream(spark: SparkSession, cmd: DataFrame, root: str, api: str = "pandas_with_state") -> DataFrame:
    write_time_chunks(command_records(cmd), f"{root}/in", "timestamp", key="key")
    src = topics.file_stream(spark, f"{root}/in", max_files_per_trigger=files_per_batch(spark, f"{root}/in"), fmt="parquet")
    fields = {"value": "double", "props": "string"}
    parsed = topics.parse_commands(src, "author", fields)
    if api == "transform_with_state":
        return commands.apply_commands_tws(parsed, fields)
    return commands.apply_commands(parsed, fields)


#: A time after all data and within pandas' range; a last row at this time lets the watermark pass all others.
END_OF_TIME = "2200-01-01 00:00:00"


@contextmanager
def rocksdb(spark: SparkSession):
    """The RocksDB state store for a query started inside; the provider is fixed into a query's checkpoint when it starts."""
    prev = spark.conf.get(PROVIDER_CONF, None)
    spark.conf.set(PROVIDER_CONF, ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        if prev is None:
            spark.conf.unset(PROVIDER_CONF)
        else:
            spark.conf.set(PROVIDER_CONF, prev)


def ordered_run(spark: SparkSession, cmd: DataFrame, arrived: str, delay: str, slot_ms: int, chunks: int = 8,
                files: int = 1, chunk: int = ordered.CHUNK) -> tuple[DataFrame, DataFrame]:
    """T3 in event time: command files in order of ``arrived``, ``files`` of them a chunk with rows in any order;
    the folded rows and the late rows."""
    root = _root(spark, "stream-ordered")
    rows = cmd if files == 1 else cmd.repartition(files)

    def fold_arrived() -> None:
        """One run over the files that came since the last, a micro-batch of them all."""
        src = spark.readStream.schema(cmd.schema).parquet(f"{root}/in").drop(arrived)
        out = ordered.ordered_commands(src, {"value": "double", "props": "string"}, delay=delay, slot_ms=slot_ms, chunk=chunk)
        with rocksdb(spark):
            q = (out.writeStream.foreachBatch(ordered.split_sink(f"{root}/applied", f"{root}/late"))
                 .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()

    write_time_chunks(rows, f"{root}/in", arrived, chunks, after=fold_arrived)
    last = cmd.agg(*[(F.max(F.lit(END_OF_TIME).cast("timestamp_ntz")) if c == "ts" else F.max(F.lit(-1)) if c == "event_id" else F.max(F.lit(None)))
                     .cast(cmd.schema[c].dataType).alias(c) for c in cmd.columns])
    last.write.mode("append").parquet(f"{root}/in")
    fold_arrived()
    return tuple(spark.read.parquet(f"{root}/{name}").drop("batch") for name in ("applied", "late"))


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


def applied_run(spark: SparkSession, cmd: DataFrame, api: str = "pandas_with_state") -> DataFrame:
    """T1 -> T2 -> T3: topic files in, one row per command out.

    transformWithState needs the RocksDB state store (several state variables per
    key).  The provider is fixed into a query's checkpoint when it starts, so it is
    set only around the start of this query and the session's value restored."""
    root = _root(spark, "stream-commands")
    stream = _applied_stream(spark, cmd, root, api)
    prev = spark.conf.get(PROVIDER_CONF, None)
    if api == "transform_with_state" and prev != ROCKSDB_PROVIDER:
        spark.conf.set(PROVIDER_CONF, ROCKSDB_PROVIDER)
    try:
        _drain(stream, f"{root}/out", f"{root}/ckpt")
    finally:
        if prev is None:
            spark.conf.unset(PROVIDER_CONF)
        else:
            spark.conf.set(PROVIDER_CONF, prev)
    return spark.read.parquet(f"{root}/out")


def replies_run(spark: SparkSession, cmd: DataFrame) -> DataFrame:
    """T3 -> T8: replies written per micro-batch by the idempotent foreachBatch sink."""
    from ..operators.commands import replies
    root = _root(spark, "stream-replies")
    rows = replies(_applied_stream(spark, cmd, root))
    q = (rows.writeStream.foreachBatch(commands.reply_sink(f"{root}/out"))
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def dedupe_run(spark: SparkSession, events: DataFrame) -> DataFrame:
    """A doubled event stream deduplicated within the watermark."""
    root = _root(spark, "stream-dedupe")
    span = write_time_chunks(events, f"{root}/in", "occurred_at")
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files_per_batch(spark, f"{root}/in")).parquet(f"{root}/in")
    out = commands.dedupe_messages(src, id_col="event_id", ts="occurred_at", delay=f"{max(span, 3600)} seconds")
    _drain(out, f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out")


def cdc_run(spark: SparkSession, initial: DataFrame, changes: DataFrame, table: str, keys: list[str],
            seq: str = "seq") -> DataFrame:
    """Change files (one append per sequence number) folded batch by batch into snapshots."""
    root = _root(spark, "stream-cdc")
    publish_snapshot(initial, f"{root}/read", table)
    write_time_chunks(changes, f"{root}/in", seq, chunks=2)
    # each micro-batch rewrites the table: as many of them as appends
    src = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", files_per_batch(spark, f"{root}/in", batches=2)).parquet(f"{root}/in")
    q = (src.writeStream.foreachBatch(cdc.cdc_sink(f"{root}/read", table, keys, seq))
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return read_snapshot(spark, f"{root}/read", table)


def bucketed_cdc_run(spark: SparkSession, initial: DataFrame, changes: DataFrame, table: str, keys: tuple[str, ...],
                     arrival: str, buckets: int = 64, seq: str = "seq") -> BucketedTable:
    """T6 on a bucketed replica: change files in order of ``arrival``, whatever their sequence numbers."""
    root = _root(spark, "stream-cdc-buckets")
    replica = BucketedTable(f"{root}/read", table, keys, buckets)
    replica.create(initial)
    write_time_chunks(changes, f"{root}/in", arrival, chunks=3)
    src = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", files_per_batch(spark, f"{root}/in")).parquet(f"{root}/in")
    q = (src.writeStream.foreachBatch(cdc.bucketed_sink(replica, seq))
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return replica


def timeout_run(spark: SparkSession, req: DataFrame, rep: DataFrame, timeout_s: int) -> DataFrame:
    """T5: request and reply streams joined with watermarks.  A marker pair far in
    event time is appended last so the watermark passes every real request."""
    root = _root(spark, "stream-timeout")
    marker_ts = F.lit("2999-01-01 00:00:00").cast("timestamp_ntz")
    span = max(write_time_chunks(req, f"{root}/req", "ts"), write_time_chunks(rep, f"{root}/rep", "rts"))
    # one marker row per stream (a global aggregate yields exactly one row)
    req.agg(F.max(F.lit(-1).cast("bigint")).alias("event_id"), F.max(marker_ts).alias("ts")) \
       .write.mode("append").parquet(f"{root}/req")
    rep.agg(F.max(F.lit(-1).cast("bigint")).alias("event_id"), F.max(marker_ts).alias("rts")) \
       .write.mode("append").parquet(f"{root}/rep")
    files = files_per_batch(spark, f"{root}/req", f"{root}/rep")
    rq = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/req")
    rp = spark.readStream.schema(rep.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/rep")
    out = replies.correlate_stream(rq, rp, timeout_s, lateness=f"{max(span, 10)} seconds")
    _drain(out, f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out").filter(F.col("event_id") >= 0)


def accounted_run(spark: SparkSession, req: DataFrame, rep: DataFrame, timeout_s: int, lateness: str, chunks: int = 4) -> tuple[DataFrame, int]:
    """T5 with late replies given back: the rows, and how many input rows came too late for any answer.  ``lateness`` is
    the caller's, whatever times the data span."""
    root = _root(spark, "stream-account")
    for df, name, ts in ((req, "req", "ts"), (rep, "rep", "rts")):
        write_time_chunks(df, f"{root}/{name}", ts, chunks)
        df.agg(F.max(F.lit(-1).cast("bigint")).alias("event_id"), F.max(F.lit(END_OF_TIME).cast("timestamp_ntz")).alias(ts)).write.mode("append").parquet(f"{root}/{name}")
    rq, rp = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{root}/{name}")
              for df, name in ((req, "req"), (rep, "rep")))
    q = _drain(replies.account_stream(rq, rp, timeout_s, lateness), f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out").filter(F.col("event_id") >= 0), replies.dropped_rows(q)
