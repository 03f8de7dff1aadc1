"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.shared import materialise, remove


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x or 0


def components(edges: DataFrame, folder: str, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that edges (u, v) reach, for every node of an edge.

    Self loops and repeated or reversed edges are fine; no edges give no rows. Each half of a round is a partial
    aggregate and a join of two written tables, so that Spark can split a hub's edges among tasks. The rounds
    grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    nodes = materialise(nodes, f"{folder}/{name}-nodes")
    now = materialise(edges.filter("u <> v").distinct(), f"{folder}/{name}-0")
    before, old = _state(now), f"{folder}/{name}-0"
    for k in range(1, max_rounds + 1):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{folder}/{name}-{k}l")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, f"{folder}/{name}-{k}a")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), f"{folder}/{name}-{k}s")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = materialise(small, f"{folder}/{name}-{k}b")
        after = _state(now)
        remove(spark, old, *[f"{folder}/{name}-{k}{part}" for part in "als"])
        old = f"{folder}/{name}-{k}b"
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
