"""Connected components by alternating large and small stars.

Each round hangs every node on the smallest node that it sees; after a number of
rounds that grows with the logarithm of the graph's width, edges form stars around
each component's smallest node. A round is a table in the shared folder, so an
executor may be lost at any time and no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import removed, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the larger of its neighbours to the smallest node it sees."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(least, "b")
    return hung.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b), roots included: root is the smallest node of its component."""
    spark = edges.sparkSession
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), folder, "round-0")
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    mark, k = state(now), 0
    while True:
        k += 1
        after = written(_small_star(_large_star(now)), folder, f"round-{k}")
        new = state(after)
        removed(spark, f"{folder}/round-{k - 1}")
        now = after
        if new == mark:
            break
        mark = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
