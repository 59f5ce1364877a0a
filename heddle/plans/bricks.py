"""Queries over volumes of 16 x 16 x 16 voxels (64 embeddings each, side by side) in bricks of 6 x 6 x 6 and thinner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import bricks as B
from heddle.session import Catalog, table

CATALOG = Catalog()
SHAPE, SIDE = (16, 16, 16), 6
V_SQL = """SELECT vec_id // 64 AS vol, CAST(vec_id // 16 % 4 * 4 + p // 16 AS INTEGER) AS k, CAST(vec_id // 4 % 4 * 4 + p // 4 % 4 AS INTEGER) AS j,
  CAST(vec_id % 4 * 4 + p % 4 AS INTEGER) AS i, embedding[p + 1]::DOUBLE AS v FROM embeddings, range(64) t(p)"""
M_SQL = f"SELECT vol, k, j, i FROM ({V_SQL}) WHERE v > -0.1"
FACES = "(VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dk, dj, di)"
BOX = "(SELECT x.d AS dk, y.d AS dj, z.d AS di FROM (VALUES (-1), (0), (1)) x(d), (VALUES (-1), (0), (1)) y(d), (VALUES (-1), (0), (1)) z(d)) o"
IN = " AND ".join(f"{c} + d{c} BETWEEN 0 AND 15" for c in "kji")


def moved(m: str, offsets: str = FACES) -> str:
    return f"SELECT vol, k + dk AS k, j + dj AS j, i + di AS i FROM ({m}), {offsets} WHERE {IN}"


def eroded(m: str) -> str:
    wanted = " + ".join(f"({c} > 0)::INT + ({c} < 15)::INT" for c in "kji")
    return f"SELECT m.vol, m.k, m.j, m.i FROM ({m}) m LEFT JOIN (SELECT vol, k, j, i, count(*) AS n FROM ({moved(m)}) GROUP BY ALL) c USING (vol, k, j, i) WHERE coalesce(n, 0) = {wanted}"


def dilated(m: str) -> str:
    return f"SELECT DISTINCT vol, k, j, i FROM ({m} UNION ALL {moved(m)})"


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.stacked(spark, table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def masked(spark: SparkSession, sf_dir: str, bit: float = B.MASK) -> DataFrame:
    return B.bricks(values(spark, sf_dir).where("v > -0.1"), SIDE, F.lit(bit))


def _places(held: DataFrame) -> DataFrame:
    return B.voxels(held, SIDE).select("vol", "k", "j", "i")


@CATALOG.add("brick_dilate", dilated(dilated(f"SELECT vol, k, j, i FROM ({V_SQL}) WHERE v > 0.2")))
def brick_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(B.filtered(B.bricks(values(spark, sf_dir).where("v > 0.2"), SIDE, F.lit(1)), [("dilate", 2)], SHAPE, SIDE))


@CATALOG.add("brick_contour", f"SELECT vol, k, j, i FROM ({M_SQL}) m ANTI JOIN ({eroded(M_SQL)}) e USING (vol, k, j, i)")
def brick_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(B.filtered(masked(spark, sf_dir), [("contour",)], SHAPE, SIDE))


@CATALOG.add("brick_opening", f"SELECT vol, k, j, i FROM ({dilated(eroded(M_SQL))}) d SEMI JOIN ({M_SQL}) m USING (vol, k, j, i)")
def brick_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(B.filtered(masked(spark, sf_dir, B.MASK | B.LIMIT), [("erode", 1), ("dilate_within", 1)], SHAPE, SIDE))


@CATALOG.add("brick_crowd", f"SELECT m.vol, m.k, m.j, m.i FROM ({M_SQL}) m JOIN ({moved(M_SQL, BOX)}) n USING (vol, k, j, i) GROUP BY ALL HAVING count(*) >= 20")
def brick_crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(B.filtered(masked(spark, sf_dir), [("crowd", 20)], SHAPE, SIDE))


MEAN_SQL = f"""SELECT a.vol, a.k, a.j, a.i, round(sum(b.v) / 27, 6) AS v FROM ({V_SQL}) a, {BOX}, ({V_SQL}) b
  WHERE a.vol = b.vol AND {' AND '.join(f'b.{c} = {{{c}}}' for c in 'kji')} GROUP BY ALL"""


# the last volume may lack vectors: only volumes of 64 are compared
@CATALOG.add("brick_box_mean", f"WITH complete AS (SELECT vec_id // 64 AS vol FROM embeddings GROUP BY 1 HAVING count(*) = 64) {MEAN_SQL.format(**{c: f'greatest(0, least(15, a.{c} + d{c}))' for c in 'kji'}).replace('WHERE', 'WHERE a.vol IN (FROM complete) AND')}")
def brick_box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, sf_dir)
    full = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 64).alias("vol")).count().where("count = 64").select("vol")
    return B.voxels(B.filtered(B.bricks(v.join(full, "vol", "left_semi"), SIDE), [("mean",)], SHAPE, SIDE, "edge"), SIDE).withColumn("v", F.round("v", 6))
