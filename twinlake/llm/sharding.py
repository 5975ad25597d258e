"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table whose size
is prime: slot (offset + j * skip) mod size, offset and skip from a digest of its
name.  Shards take turns (``weight`` turns a round); in a turn a shard claims the
first slot of its order that is still free.  A row's place is then one lookup:
digest of its key modulo the table's size.  The table has ``size`` rows, whatever
the corpus, and is broadcast.  Shards differ by at most one slot a unit of weight,
and removing one shard leaves nearly all slots of the others where they were.

Results in special cases
* Null key: hashed as its own value, so all null keys share a shard.
* Rows with equal keys share a shard, ties and repeated rows included.
* Empty table: empty result.  The text is not read.
* No shards, repeated names, weights under 1 or more shards than slots: ValueError.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import documents

#: Prime size of the table and bound of the broadcast.
TABLE_SIZE = 65_537
N_SHARDS = 64


def preference(name: str, size: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "little") % size, int.from_bytes(digest[8:16], "little") % (size - 1) + 1


def lookup_table(shards: dict[str, int], size: int = TABLE_SIZE) -> list[int]:
    """The owner (index into ``shards``) of each slot.  ``shards``: name -> weight."""
    if not shards or min(shards.values()) < 1 or sum(shards.values()) > size:
        raise ValueError("shards need names, weights of 1 or more and fewer turns than slots")
    if size < 3 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"{size} is not a prime")
    owner, free = [-1] * size, size
    turns = [(i, *preference(name, size)) for i, name in enumerate(shards)]
    at = [offset for _, offset, _ in turns]
    weights = list(shards.values())
    while True:
        for i, _, skip in turns:
            for _ in range(weights[i]):
                slot = at[i]
                while owner[slot] >= 0:
                    slot = (slot + skip) % size
                owner[slot] = i
                at[i] = (slot + skip) % size
                free -= 1
                if not free:
                    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """First 15 hex digits of the key's md5, modulo the table's size."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\0null"))), 1, 15), 16, 10).cast("long") % size).cast("int")


def table_frame(spark: SparkSession, shards: dict[str, int], size: int = TABLE_SIZE) -> DataFrame:
    names = list(shards)
    return spark.createDataFrame([(s, names[i]) for s, i in enumerate(lookup_table(shards, size))], "_slot int, _shard string")


def assign(docs: DataFrame, shards: dict[str, int], key: str = "doc_id", size: int = TABLE_SIZE,
           slot_as: str = "slot", shard_as: str = "shard") -> DataFrame:
    """``docs`` with each row's slot and shard.  No shuffle: the table (``size`` rows) is broadcast.
    Columns of ``docs`` with the two names are replaced."""
    names = [c for c in docs.columns if c not in (slot_as, shard_as)]
    rows = docs.select(F.struct(slot_of(F.col(key), size).alias("slot"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("_row"))
    placed = rows.join(F.broadcast(table_frame(docs.sparkSession, shards, size)), F.col("_row.slot") == F.col("_slot"))
    return placed.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)], F.col("_slot").alias(slot_as), F.col("_shard").alias(shard_as))


def write_shards(docs: DataFrame, shards: dict[str, int], path: str, key: str = "doc_id", files_per_shard: int = 4,
                 size: int = TABLE_SIZE) -> None:
    """One folder for each shard, ``shard=<name>``, of several files: a large shard is dealt over several tasks."""
    placed = assign(docs, shards, key, size, slot_as="_slot_of_row")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(files_per_shard))
    n = min(len(shards) * files_per_shard, 20_000)
    placed.repartition(n, F.col("shard"), salt).drop("_slot_of_row").write.partitionBy("shard").mode("errorifexists").parquet(path)


def default_shards(n: int = N_SHARDS) -> dict[str, int]:
    return {f"shard-{i:03d}": 1 for i in range(n)}


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir).select("doc_id"), default_shards())
