"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import apart, stage


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One step: each node's neighbours (``both``: larger ones; else the node and smaller ones)
    are joined to the least of them and the node. Minima are pre-aggregated before the shuffle,
    so a node with very many neighbours is one row a task there."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = near.join(apart(least, "a"), "a")
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that some link touches; the component is the smallest
    node reachable. Links may repeat, point either way or join a node to itself; nulls are
    ignored. No links: an empty table. Links stay distributed; only a count and a checksum of
    each round reach the driver."""
    edges = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = stage(edges, "links")
    sign = None
    for _ in range(rounds):
        edges = stage(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
