"""Connected components by alternating large and small stars, with durable rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogeo.session import durable


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b); label is the least node reachable.

    A round shuffles each edge a few times; the number of rounds grows with the
    logarithm of the longest chain. Nothing but counts reaches the driver.
    """
    edges = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The joined sides are tables of their own, so that Spark can split a node with very many edges.
        least = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        least = durable(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        following = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = durable(following.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = _signature(edges)
        if now == before:
            break
        before = now
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops)
