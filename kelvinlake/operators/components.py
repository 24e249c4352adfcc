"""Connected components of an edge table, by alternating large and small stars.

Each round is a grouped minimum and a join, so no node's neighbours ever meet in
one object, and the join on a hub is one that adaptive execution can split. The
edge table is written between rounds; its lineage never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvinlake.scratch import Scratch


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"),
    ).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    linked = down.join(low, "u").where("v != low").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return linked.unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the least node.

    Edges with a null end and loops are ignored: a node that has no other edge
    is not in the result, its component is itself.
    """
    now = scratch.store(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = _fingerprint(now)
    while before[0]:
        was = now
        now = scratch.store(_small_star(_large_star(now).distinct()).distinct(), "stars")
        scratch.drop(was)
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
