"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces a node's edges by edges to the smallest node it knows; after
O(log n) rounds every node points at the smallest node of its component.  Edges
stay in Spark; each round is written to the shared checkpoint folder, and the
driver sees one row a round: the number of edges and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import pin


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): component is the smallest node it reaches.

    Loops and repeated edges change nothing; edges with a null end are ignored; no edges give an empty table.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = pin(e.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") > F.col("v"))).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") > F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = pin(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
