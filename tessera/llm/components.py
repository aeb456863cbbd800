"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def _with_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and all v of u. An aggregate and a join, so that a hub's links can be dealt to many tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    linked = _with_min(down)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, label): for each node that has a link, the smallest node reachable. links: (u, v) of one orderable type.

    Each round is checkpointed; the number of rounds grows with the logarithm of the longest path. Self-links are ignored.
    """
    edges, seen = checkpointed(links.select("u", "v").filter("u <> v").distinct(), spark), None
    while True:
        edges = checkpointed(_small_star(_large_star(edges)), spark)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        seen = state
