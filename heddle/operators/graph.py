"""Components, smoothing and traversal over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.lineage import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one orderable type. Returns node, component (the smallest node reachable) for every node with an edge.

    Alternating star rounds: every node's larger, then smaller, neighbours are hung on its smallest neighbour, until
    all hang on a root. A round is two sums by key and two equi-joins; a count and a checksum reach the driver.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = _both(e)
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def taubin(nodes: DataFrame, edges: DataFrame, columns: list[str], rounds: int, shrink: float = 0.5, swell: float = -0.53) -> DataFrame:
    """nodes: node and coordinates; edges: a, b. Each round moves every node by `shrink`, then by `swell`, of the way to
    its neighbours' mean; nodes without neighbours stay."""
    both = cut(_both(edges).distinct())
    for _ in range(rounds):
        for part in (shrink, swell):
            mean = both.join(nodes, both["b"] == nodes["node"]).groupBy("a").agg(*[F.avg(c).alias(f"__{c}") for c in columns])
            moved = [F.coalesce(F.col(c) + part * (F.col(f"__{c}") - F.col(c)), F.col(c)).alias(c) for c in columns]
            nodes = cut(nodes.join(mean, nodes["node"] == mean["a"], "left").select("node", *moved))
    return nodes


def descend(nodes: DataFrame, own: list[str], join: list[Column], limit: int = 1000) -> DataFrame:
    """nodes: node, parent (null at a root) and columns `own`. Each level's rows are joined to their children, whose columns
    become the expressions in `join` over p_<column> and c_<column>. A cycle ends in an error after `limit` levels."""
    level = nodes.where("parent is null").select("node", F.lit(0).alias("depth"), *own)
    out = level
    child = nodes.where("parent is not null").select(F.col("node").alias("__n"), F.col("parent").alias("__p"), *[F.col(c).alias(f"c_{c}") for c in own])
    for depth in range(1, limit + 1):
        up = level.select("node", *[F.col(c).alias(f"p_{c}") for c in own])
        level = cut(child.join(up, child["__p"] == up["node"]).select(F.col("__n").alias("node"), F.lit(depth).alias("depth"), *[j.alias(c) for j, c in zip(join, own)]))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {limit} levels")
