"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import settle


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a, b. Returns node, root (the smallest node of its component) for every node that has an edge."""
    edges = settle(edges.select("a", "b").distinct())
    before = None
    for _ in range(max_rounds):
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        down = large.join(small_least, "b")
        small = down.filter("a <> m").select("m", F.col("a").alias("v")).unionByName(small_least.select("m", F.col("b").alias("v")))
        edges = settle(small.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
