"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work


def _minima(both: DataFrame) -> DataFrame:
    return both.groupBy("a").agg(F.min("b").alias("m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(work: Work, links: DataFrame) -> DataFrame:
    """links: two long columns a, b. Returns node, component (the smallest node reachable) for every node with a link.

    Every round is a sum by key and a join of two written tables, so a node with very many links is split by
    adaptive execution; only a row count and a checksum reach the driver. Nulls and self links are left out.
    An empty table gives an empty one.
    """
    edges = work.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = work.save(_minima(both).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work.save(large, "large")
        low2 = work.save(_minima(large), "low")
        joined = large.join(low2, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        after = work.save(small, "edges")
        work.drop(edges, low, large, low2)
        edges, before = after, state
        state = _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
