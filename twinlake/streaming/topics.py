"""Topic sources and sinks.

Messages have the Kafka record shape ``(topic, key, value, timestamp, partition,
offset)``.  ``kafka_stream`` reads a real broker (needs the Kafka connector on
the classpath); ``file_stream`` reads the same shape from JSON-lines files, which
is what tests and offline replays use.  Payloads are parsed to
``map<string,string>`` rather than a struct so an absent field and an explicit
``null`` stay distinguishable (``map_contains_key``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])

# The twelve message patterns the service subscribes to.
TOPICS = (
    "author.create", "author.update", "author.delete", "author.get", "author.getAll",
    "book.create", "book.update", "book.delete", "book.get", "book.getAll",
    "authorBook.assign", "authorBook.unassign",
)


def kafka_stream(spark: SparkSession, bootstrap: str, topics=TOPICS, **options) -> DataFrame:
    """Subscribe to the topics on a broker; same columns as ``file_stream``."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", ",".join(topics)))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load().select("topic", F.col("key").cast("string"), F.col("value").cast("string"),
                           F.col("timestamp").cast("timestamp_ntz"), "partition", "offset")


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                fmt: str = "json") -> DataFrame:
    """Topic records from files (``json`` lines or ``parquet``) with the record schema."""
    r = spark.readStream.schema(RECORD_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "json":
        r = r.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    return r.load(path)


def to_records(df: DataFrame, topic: Column, key: Column, fields: dict[str, tuple[Column, Column]],
               ts: Column, offset: Column, partitions: int = 4) -> DataFrame:
    """Encode rows as topic records.  ``fields`` maps payload name -> (present?, value);
    absent fields are left out of the JSON, present NULLs are written as null."""
    entries = F.array(*[F.when(p, F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")))
                        for n, (p, v) in fields.items()])
    payload = F.to_json(F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())))
    return df.select(topic.alias("topic"), key.cast("string").alias("key"), payload.alias("value"),
                     ts.alias("timestamp"), F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int").alias("partition"),
                     offset.cast("long").alias("offset"))


def write_records(records: DataFrame, path: str, chunks: int = 1, order: str = "timestamp") -> None:
    """Write records as JSON-lines files; with ``chunks`` > 1 the records are split
    into that many time-ordered files so a file stream sees several batches."""
    if chunks <= 1:
        records.write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
        return
    ranged = records.repartitionByRange(chunks, order).sortWithinPartitions(order, "offset")
    ranged.write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def emit(records: DataFrame, path: str | None = None, bootstrap: str | None = None, partitions: int = 4, **options) -> None:
    """Send ``(event_id, topic, key, value)`` rows to their topics, with the record shape of ``file_stream``.

    ``bootstrap``: to a broker (needs the Kafka connector); ``path``: to JSON-lines files, one directory a topic, a key's
    records of one write in one file in the order of ``event_id``, as a broker keeps them in a partition.
    """
    if bootstrap:
        w = records.select("topic", "key", "value").write.format("kafka").option("kafka.bootstrap.servers", bootstrap)
        for k, v in options.items():
            w = w.option(k, v)
        w.save()
        return
    part = F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int")
    rows = records.select("topic", F.col("topic").alias("_dir"), "key", "value", F.lit(None).cast("timestamp_ntz").alias("timestamp"),
                          part.alias("partition"), F.col("event_id").cast("long").alias("offset"))
    rows.repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset").write.mode("append").partitionBy("_dir").json(path)


def payload_map(value: Column) -> Column:
    return F.from_json(value, T.MapType(T.StringType(), T.StringType()))


def parse_commands(records: DataFrame, entity: str, fields: dict[str, str], key_type: str = "bigint") -> DataFrame:
    """Route one entity's topics to a typed command frame
    ``(event_id, ts, id, op, has_<f>..., <f>...)``; other topics are dropped."""
    m = payload_map(F.col("value"))
    op = F.substring_index(F.col("topic"), ".", -1)
    cols = [F.col("offset").alias("event_id"), F.col("timestamp").alias("ts"),
            F.col("key").cast(key_type).alias("id"), op.alias("op")]
    for f, t in fields.items():
        cols.append(F.map_contains_key(m, f).alias(f"has_{f}"))
    for f, t in fields.items():
        cols.append(m[f].cast(t).alias(f))
    return records.filter(F.col("topic").startswith(entity + ".")).select(*cols)
