"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf.  The leaves of a group, in order, are the bottom level of a
binary tree; the groups' roots (subroots), in order, are that of the top tree.

Time-forward processing evaluates such a circuit without random access: nodes are
labelled so that a child comes before its parent, a node sends its digest to its
parent's label, and a priority queue ordered by label hands each node its messages
when the sweep reaches it.  The label of a node is (its last leaf, its level): the
queue then holds one open node a level.  Spark's sorting shuffle is the external
part of the queue: a tree is cut into blocks of ``2**BITS`` leaves, messages to a
block are dealt by (tree, block) and sorted by label on disk, a task sweeps its
blocks one after the other, and a block's root is a message of the next round.
A tree of n leaves takes log2(n) / BITS rounds, each a checkpointed table of
``2**BITS`` times fewer rows.

A proof is the list of siblings from the leaf to the root.  The reversed sweep
delivers it from above: a node's message to a child is the child's sibling and the
node's own suffix.  Only block roots receive suffixes through the shuffle (one
message a block), so no more than one proof a block is ever moved.

Results in special cases
* Null fields count as ``-``; texts of any length are hashed in the JVM and never moved.
* Null group: a group of its own, before the others.  Null order value: before the others.
* Equal order values: by leaf digest; rows that are equal in all fields have equal leaves and take neighbouring places.
* A group with one row: the leaf is the subroot.  One group: its subroot is the root.  Empty table: empty result.
* A group of any size is ranked by many tasks (ranges of the order) and swept by many tasks (blocks).
* Only the named fields are read; other columns do no harm whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import documents, pin

#: Levels that one block spans; its leaves and their proofs fit easily in a task.
BITS = 9
#: Rows that one range of the ranking should hold.
RANK_ROWS = 1_000_000
#: Fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# -- leaves and proofs, in the JVM ----------------------------------------------

def field(value: Column) -> Column:
    """One field of a leaf: ``-``, or its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def siblings(proof: Column) -> Column:
    """The sibling digests of a proof, without the levels that have none."""
    return F.filter(F.transform(proof, lambda s: F.substring(s, 2, 64)), lambda d: d != "")


def folded(leaf_digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give: at each level the digest of the node and its sibling, in order."""
    def step(node, entry):
        side, digest = F.substring(entry, 1, 1), F.substring(entry, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(digest, node)).when(side == "R", F.concat(node, digest)).otherwise(node), 256)

    return F.aggregate(proof, leaf_digest, step)


# -- one block: the queue in a task ---------------------------------------------

def _digest(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def sweep(leaves: list[str], height: int) -> list[list[str]]:
    """Digests of a block's nodes, level by level.  Leaves are met in order; a message (label, level, node, digest)
    waits in the queue until the sweep reaches its receiver's label."""
    m, levels, queue = len(leaves), [[] for _ in range(height + 1)], []

    def send(level: int, j: int, digest: str) -> None:
        levels[level].append(digest)
        if level < height:
            last = min(((j >> 1) + 1) << (level + 1), m) - 1  # the parent's last leaf
            heapq.heappush(queue, (last, level + 1, j >> 1, j & 1, digest))

    for i, digest in enumerate(leaves):
        send(0, i, digest)
        while queue and queue[0][0] == i:
            _, level, j, _, first = heapq.heappop(queue)
            second = [heapq.heappop(queue)[4]] if queue and queue[0][:3] == (i, level, j) else []
            send(level, j, _digest(first, *second))
    return levels


def suffixes(levels: list[list[str]], above: list[str]) -> list[list[str]]:
    """The proof of every leaf of a block, given that of its root: the sweep in reverse, labels falling."""
    height, m = len(levels) - 1, len(levels[0])
    queue, proofs = [(-(m - 1), -height, 0, above)], [above] * m
    while queue:
        _, level, j, proof = heapq.heappop(queue)
        level = -level
        if level == 0:
            proofs[j] = proof
            continue
        below, children = levels[level - 1], [c for c in (2 * j, 2 * j + 1) if c < len(levels[level - 1])]
        for c in children:
            entry = "-" if len(children) == 1 else ("R" + below[c + 1] if c == children[0] else "L" + below[c - 1])
            heapq.heappush(queue, (-(min((c + 1) << (level - 1), m) - 1), 1 - level, c, [entry, *proof]))
    return proofs


def _height(n: int) -> int:
    """Levels that a block adds to a tree of n nodes."""
    return min(BITS, (n - 1).bit_length())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of a sorted partition, one at a time, however the batches cut them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        tree, block = table["g"].combine_chunks().dictionary_encode().indices.to_numpy(), table["b"].to_numpy()
        cuts = [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = {"g": [], "i": [], "digest": [], "n": []}

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out["g"], pa.string()), pa.array(out["i"], pa.int64()), pa.array(out["digest"], pa.string()), pa.array(out["n"], pa.int64())],
                                           names=list(out))
        for column in out.values():
            column.clear()
        return batch

    for block in _blocks(batches):
        n = block["n"][0].as_py()
        out["g"].append(block["g"][0].as_py())
        out["i"].append(block["b"][0].as_py())
        out["digest"].append(sweep(block["digest"].to_pylist(), _height(n))[-1][0])
        out["n"].append(-(-n >> BITS) if n > 1 else 1)
        if len(out["g"]) >= 1000:
            yield flush()
    yield flush()


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the message for their root in front (``i`` is -1); the rows of the others, each with its proof."""
    for block in _blocks(batches):
        message, rows = block.slice(0, 1), block.slice(1)
        levels = sweep(rows["digest"].to_pylist(), _height(rows["n"][0].as_py()))
        proofs = suffixes(levels, message["proof"][0].as_py())
        m = rows.num_rows
        yield from pa.table([rows["g"], rows["i"], rows["digest"], pa.array(proofs, pa.list_(pa.string())),
                             pa.chunked_array([pa.repeat(message["subroot"][0], m)]), rows["row"]],
                            names=["g", "i", "digest", "proof", "subroot", "row"]).combine_chunks().to_batches()


# -- rounds ------------------------------------------------------------------

def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (g, digest, ...) with their place ``i`` in their tree, by ``order``, and the tree's size ``n``.

    Ranges of (g, order, tie) are sorted by many tasks; a row's place is its distance from the first row of its
    tree in its range, and the sizes of the earlier ranges.  The tie is the row's own number, so equal rows, too, are split."""
    keys = ["g", *order, "_tie"]
    pinned = pin(rows.withColumn("_tie", F.monotonically_increasing_id()))
    spark = rows.sparkSession
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pinned.count() // RANK_ROWS))
    placed = pin(pinned.repartitionByRange(n_ranges, *keys).sortWithinPartitions(*keys)).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy("g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("g", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .select("g", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("g")).alias("n")))
    return (placed.join(starts, ["g", "_range"]).withColumn("i", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_tie", "_at", "_range", "_first", "_before"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("g", "b").sortWithinPartitions("g", "b", "i")


class Forest:
    """Trees over ``rows`` (g, i, n, digest, row): ``rounds`` holds the nodes that each round starts from,
    ``roots`` the trees' roots (g, digest)."""

    def __init__(self, rows: DataFrame):
        self.rounds = [pin(rows.select("g", "i", "n", "digest", "row"))]
        size = self.rounds[0].agg(F.max("n")).first()[0] or 1  # one row: the largest tree
        while True:
            nodes = self.rounds[-1].select("g", F.shiftright("i", BITS).alias("b"), "i", "digest", "n")
            top = pin(_dealt(nodes).mapInArrow(_up, "g string, i long, digest string, n long"))
            size = -(-size >> BITS)
            if size <= 1:
                self.roots = top.select("g", "digest")
                return
            self.rounds.append(top.withColumn("row", F.lit(None).cast("struct<>")))

    def proofs(self, roots: DataFrame) -> DataFrame:
        """(g, i, digest, proof, subroot, row) of every row, from the (g, proof, subroot) of its tree's root."""
        above = roots.select("g", F.lit(0).cast("long").alias("b"), "proof", "subroot")
        for nodes in reversed(self.rounds):
            row = nodes.schema["row"].dataType
            rows = nodes.select("g", F.shiftright("i", BITS).alias("b"), "i", "digest", "n", F.lit(None).cast("array<string>").alias("proof"),
                                F.lit(None).cast("string").alias("subroot"), "row")
            messages = above.select("g", "b", F.lit(-1).cast("long").alias("i"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("n"),
                                    "proof", "subroot", F.lit(None).cast(row).alias("row"))
            done = _dealt(rows.unionByName(messages)).mapInArrow(
                _down, f"g string, i long, digest string, proof array<string>, subroot string, row {row.simpleString()}")
            if nodes is self.rounds[0]:
                return done
            above = pin(done.select("g", F.col("i").alias("b"), "proof", "subroot"))


def manifest(rows: DataFrame, fields: list[str] = FIELDS, order: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """Every row's leaf, group (``tree``), place, subroot, root and proof, and the columns ``carry`` computes from it.

    A proof has an entry for each level from the leaf to the root: ``L`` or ``R`` (the sibling's side) and the
    sibling's digest, or ``-`` where the node is alone.
    """
    carried = F.struct(F.col(order).alias("o"), *[c.alias(f"c{k}") for k, c in enumerate((carry or {}).values())])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # "-" sorts before "="
    leaves = rows.select(tree.alias("g"), leaf([F.col(f) for f in fields]).alias("digest"), carried.alias("row")).withColumn("o", F.col("row.o"))
    forest = Forest(ranked(leaves, ["o", "digest"]))
    top = Forest(ranked(forest.roots.select(F.lit("").alias("g"), F.col("g").alias("o"), "digest", F.struct("g", "digest").alias("row")), ["o"]))
    root = top.roots.first()  # one row
    whole = root["digest"] if root else ""
    subroots = top.proofs(top.roots.select("g", F.array().cast("array<string>").alias("proof"), F.lit("").alias("subroot")))
    done = forest.proofs(pin(subroots.select("row.g", "proof", F.col("row.digest").alias("subroot"))))
    return done.select(F.col("row.o").alias(order), F.when(F.col("g") != "-", F.expr("substring(g, 2)")).alias("tree"), F.col("i").alias("place"), F.col("digest").alias("leaf"),
                       "subroot", F.lit(whole).alias("root"), "proof", *[F.col(f"row.c{k}").alias(name) for k, name in enumerate(carry or {})])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_text = F.col("doc_id").cast("string")
    touched = (F.pmod(F.crc32(id_text.cast("binary")), F.lit(7)) == 0) & F.col("n_chars").isNotNull()
    changed = leaf([F.try_add("n_chars", F.lit(1).cast("long")) if f == "n_chars" else F.col(f) for f in FIELDS])
    rows = manifest(documents(spark, sf_dir), carry={"changed": F.when(touched, changed)})
    return (rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
            .select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings(F.col("proof")), ""), 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


#: One bit of CRC-32 (reflected, polynomial 0xEDB88320), eight for each byte of the decimal id.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
      lambda x, unused: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND ({_CRC}) % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS changed FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (
  SELECT g, 0 AS level, i, leaf AS d, n FROM placed
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, level, i // 2, n),
subroots AS (
  SELECT g, d AS subroot, row_number() OVER (ORDER BY CAST(g AS BLOB)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, subroot AS d, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (
  SELECT p.doc_id, p.g, p.i, v.level, CASE WHEN s.d IS NULL THEN '-' WHEN s.i > v.i THEN 'R' || s.d ELSE 'L' || s.d END AS step
  FROM placed p JOIN nodes v ON v.g = p.g AND v.i = p.i >> v.level AND v.n > 1
  LEFT JOIN nodes s ON s.g = v.g AND s.level = v.level AND s.i = xor(v.i, 1)
  UNION ALL
  SELECT p.doc_id, p.g, p.i, 1000 + v.level, CASE WHEN s.d IS NULL THEN '-' WHEN s.i > v.i THEN 'R' || s.d ELSE 'L' || s.d END
  FROM placed p JOIN subroots r ON r.g = p.g JOIN tops v ON v.i = r.i >> v.level AND v.n > 1
  LEFT JOIN tops s ON s.level = v.level AND s.i = xor(v.i, 1)),
proofs AS (SELECT g, i, list(step ORDER BY level) AS proof FROM steps GROUP BY g, i),
folds AS (
  SELECT p.doc_id, p.leaf, r.subroot, (SELECT d FROM tops WHERE n = 1) AS root, coalesce(f.proof, []) AS proof, coalesce(p.changed, p.leaf) AS first
  FROM placed p JOIN subroots r ON r.g = p.g LEFT JOIN proofs f ON f.g = p.g AND f.i = p.i)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda s: substr(s, 2)), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce(list_prepend(first, proof), lambda node, s: sha256(CASE s[1] WHEN 'L' THEN substr(s, 2) || node WHEN 'R' THEN node || substr(s, 2) ELSE node END)) AS folded_root
      FROM folds)
"""
