"""Connected components of a link table by alternating star contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinseek.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def roots(edges: DataFrame) -> DataFrame:
    """For links (u, v) the table (u, root) of all nodes that are not their component's least node, which is the root.

    The number of rounds grows with the logarithm of the largest component. Every round is written to the shared folder.
    """
    edges = stored(edges.filter(F.col("u") != F.col("v")).distinct(), "links")
    sign = None
    while True:
        turned = _small_star(_large_star(edges)).filter(F.col("u") != F.col("v")).distinct()
        edges = stored(turned, "links")
        found = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (found["n"], found["x"]) == sign:
            return edges.select("u", F.col("v").alias("root"))
        sign = (found["n"], found["x"])
