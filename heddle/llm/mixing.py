"""Mixing sources to target weights by systematic sampling.

A source's target is its share by weight of the words to take, at most CAP times its own words; what stays over is
shared again by weight until no source is above. A source's documents all have the same number of expected copies,
target / size of the source. Along the source's documents, in order of size, the prefix sum of expected copies plus
one random offset is followed, and a document is emitted once for each integer passed. In order of size the words
taken stay within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import WORD, Work, ranked, table, unit

WEIGHTS = (5, 2, 1)
CAP = 3.0


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(work: Work, sized: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """sized: source, size. Returns source, source_size, target; only sums over all sources reach the driver."""
    totals = work.save(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    placed = ranked(work, totals, [], ["source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = work.save(placed.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap), "placed")
    row = placed.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    level, want, before = 0.0, share * float(row["all"] or 0), -1
    if want:
        level = want / row["w"]
        while True:
            full = F.col("most") <= F.lit(level) * F.col("weight")
            got = placed.agg(F.sum(F.when(full, F.col("most"))).alias("most"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
            if got["n"] == before or not got["w"]:
                break
            before, level = got["n"], (want - (got["most"] or 0.0)) / got["w"]
    return placed.select("source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def copies(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, share: float = 1.0, seed: int = 0) -> DataFrame:
    """Every document with the number of times that the mix emits it: doc_id, source, size, source_size, target, copies.

    Size is the number of words; null text: 0. A null source is a source of its own, last in order. A source without
    words has target 0 and no copies. Repeated rows are documents each; a null doc_id comes last among equal sizes.
    An empty table gives an empty one. The offset depends on the source and the seed alone, so reruns agree.
    """
    work = Work(docs.sparkSession, "mixing")
    sized = work.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size")), "sized")
    goal = work.save(targets(work, sized, weights, cap, share), "targets")
    place = ranked(work, sized, ["source"], ["size", "doc_id"], "place")
    g = goal.select(F.col("source").alias("source2"), "source_size", "target")
    rows = place.join(F.broadcast(g) if goal.count() <= 10_000 else g, F.col("source").eqNullSafe(F.col("source2")), "left").drop("source2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    passed = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    rows = rows.withColumn("rate", rate).withColumn("offset", unit("source", seed))
    emitted = F.least(passed(F.col("place")) - passed(F.col("place") - 1), F.lit(int(cap)).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", emitted.cast("long").alias("copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS most FROM s
), c AS (
  SELECT *, sum(most) OVER o AS capped, sum(weight) OVER () - sum(weight) OVER o AS rest, sum(source_size) OVER () AS want,
         lead(most / weight) OVER (ORDER BY most / weight, source NULLS LAST) AS after,
         row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT arg_min(level, k) AS level FROM (
    SELECT (want - capped) / rest AS level, k FROM c WHERE rest > 0 AND after > (want - capped) / rest
    UNION ALL
    SELECT sum(source_size) / sum(weight), 0 FROM w HAVING min(most / weight) > sum(source_size) / sum(weight))
), t AS (
  SELECT source, source_size, least(most, coalesce(level, 0) * weight) AS target,
         CAST('0x' || substr(md5(coalesce('s' || source, 'n') || '|0'), 1, 6) AS BIGINT) / 16777216.0::DOUBLE AS u
  FROM w, l
), r AS (
  SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(least(floor(n * rate + u) - floor((n - 1) * rate + u), 3) AS BIGINT) * size AS taken FROM r
"""
