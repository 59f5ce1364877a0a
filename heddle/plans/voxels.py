"""Queries over voxel volumes: each embedding is a grid of 4 x 4 x 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import voxels as V
from heddle.session import Catalog, table

CATALOG = Catalog()
SHAPE = (4, 4, 4)
G_SQL = "SELECT vec_id AS vol, CAST(p // 16 AS INTEGER) AS k, CAST((p // 4) % 4 AS INTEGER) AS j, CAST(p % 4 AS INTEGER) AS i, CAST(p AS BIGINT) AS p, embedding[p + 1]::DOUBLE AS v FROM embeddings, range(64) t(p)"
M_SQL = f"SELECT vol, k, j, i, p FROM ({G_SQL}) WHERE v > 0"
NEAR = "abs(a.k - b.k) + abs(a.j - b.j) + abs(a.i - b.i)"
STEPS = "(VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dk, dj, di)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dense(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SHAPE)


def mask(spark: SparkSession, sf_dir: str, least: float = 0.0) -> DataFrame:
    return grid(spark, sf_dir).where(F.col("v") > least).select(*V.KEY)


def dilate_sql(m: str) -> str:
    return f"SELECT DISTINCT vol, k + dk AS k, j + dj AS j, i + di AS i FROM ({m}), {STEPS} WHERE k + dk BETWEEN 0 AND 3 AND j + dj BETWEEN 0 AND 3 AND i + di BETWEEN 0 AND 3"


def erode_sql(m: str) -> str:
    near = f"SELECT vol, k + dk AS k, j + dj AS j, i + di AS i FROM ({m}), {STEPS} WHERE abs(dk) + abs(dj) + abs(di) = 1"
    return f"""SELECT m.vol, m.k, m.j, m.i FROM ({m}) m LEFT JOIN (SELECT vol, k, j, i, count(*) AS n FROM ({near}) GROUP BY ALL) c USING (vol, k, j, i)
      WHERE coalesce(n, 0) = (k > 0)::INT + (k < 3)::INT + (j > 0)::INT + (j < 3)::INT + (i > 0)::INT + (i < 3)::INT"""


def label_sql(m: str, plane: bool = False) -> str:
    """Labels by spreading reachable pairs."""
    step = f"abs(dk) + abs(dj) + abs(di) = 1{' AND dk = 0' if plane else ''}"
    return f"""(WITH RECURSIVE m AS ({m}), e AS (SELECT a.vol, a.k * 16 + a.j * 4 + a.i AS x, b.k * 16 + b.j * 4 + b.i AS y FROM m a, {STEPS}, m b WHERE {step} AND a.vol = b.vol AND b.k = a.k + dk AND b.j = a.j + dj AND b.i = a.i + di),
      r AS (SELECT vol, k * 16 + j * 4 + i AS x, k * 16 + j * 4 + i AS y FROM m UNION SELECT r.vol, r.x, e.y FROM r JOIN e ON r.vol = e.vol AND r.y = e.x)
      SELECT vol, CAST(x // 16 AS INTEGER) AS k, CAST((x // 4) % 4 AS INTEGER) AS j, CAST(x % 4 AS INTEGER) AS i, CAST(min(y) AS BIGINT) AS label FROM r GROUP BY vol, x)"""


def largest_sql(m: str) -> str:
    lab = label_sql(m)
    return f"SELECT vol, k, j, i FROM {lab} l SEMI JOIN (SELECT vol, label FROM (SELECT vol, label, row_number() OVER (PARTITION BY vol ORDER BY count(*) DESC, label) AS r FROM {lab} GROUP BY vol, label) WHERE r = 1) b USING (vol, label)"


@CATALOG.add("dilate6", dilate_sql(M_SQL))
def dilate6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dilate(mask(spark, sf_dir), SHAPE)


@CATALOG.add("erode6", erode_sql(M_SQL))
def erode6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.erode(mask(spark, sf_dir), SHAPE)


@CATALOG.add("contour6", f"SELECT vol, k, j, i FROM ({M_SQL}) m ANTI JOIN ({erode_sql(M_SQL)}) e USING (vol, k, j, i)")
def contour6(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mask(spark, sf_dir)
    return m.join(V.erode(m, SHAPE), V.KEY, "left_anti")


BOX_SQL = f"SELECT a.vol, a.k, a.j, a.i, sum(b.v) AS v FROM ({G_SQL}) a, (SELECT x.d AS dk, y.d AS dj, z.d AS di FROM (VALUES (-1), (0), (1)) x(d), (VALUES (-1), (0), (1)) y(d), (VALUES (-1), (0), (1)) z(d)) o, ({G_SQL}) b WHERE a.vol = b.vol AND b.k = {{k}} AND b.j = {{j}} AND b.i = {{i}} GROUP BY a.vol, a.k, a.j, a.i"
EDGE = {c: f"greatest(0, least(3, a.{c} + d{c}))" for c in "kji"}
WRAP = {c: f"(a.{c} + d{c} + 4) % 4" for c in "kji"}
ZERO = {c: f"a.{c} + d{c}" for c in "kji"}


@CATALOG.add("box_mean27", f"SELECT vol, k, j, i, round(v / 27, 6) AS v FROM ({BOX_SQL.format(**EDGE)})")
def box_mean27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.box_sum(grid(spark, sf_dir)).withColumn("v", F.round(F.col("v") / 27, 6))


@CATALOG.add("box_sum_wrap", f"SELECT vol, k, j, i, round(v, 6) AS v FROM ({BOX_SQL.format(**WRAP)})")
def box_sum_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.box_sum(grid(spark, sf_dir), "wrap").withColumn("v", F.round("v", 6))


@CATALOG.add("box_sum_constant", f"SELECT vol, k, j, i, round(v, 6) AS v FROM ({BOX_SQL.format(**ZERO)})")
def box_sum_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.box_sum(grid(spark, sf_dir), "constant").withColumn("v", F.round("v", 6))


CROWD_SQL = f"SELECT a.vol, a.k, a.j, a.i FROM ({M_SQL}) a JOIN ({M_SQL}) b ON a.vol = b.vol AND abs(a.k - b.k) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.i - b.i) <= 1 GROUP BY ALL HAVING count(*) >= 9"


@CATALOG.add("neighbour_filter", CROWD_SQL)
def neighbour_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.keep_crowded(mask(spark, sf_dir), 9, SHAPE)


@CATALOG.add("components", f"SELECT * FROM {label_sql(M_SQL)}")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.label_small(mask(spark, sf_dir), SHAPE)


@CATALOG.add("components_large", f"SELECT * FROM {label_sql(M_SQL)}")
def components_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.label(mask(spark, sf_dir), SHAPE).withColumn("label", F.col("label").cast("long"))


@CATALOG.add("components_plane", f"SELECT * FROM {label_sql(M_SQL, True)}")
def components_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.label_small(mask(spark, sf_dir), SHAPE, True)


@CATALOG.add("largest_component", largest_sql(M_SQL))
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.largest(V.label_small(mask(spark, sf_dir), SHAPE))


THIN_SQL = f"SELECT vol, k, j, i FROM ({G_SQL}) WHERE v > -0.1"
GROW_SQL = f"""SELECT vol, k, j, i FROM {label_sql(THIN_SQL)} l SEMI JOIN (SELECT l.vol, l.label FROM {label_sql(THIN_SQL)} l JOIN (
    SELECT vol, k, j, i FROM (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY (k - 1) * (k - 1) + (j - 1) * (j - 1) + (i - 1) * (i - 1), k, j, i) AS r FROM ({THIN_SQL})) WHERE r = 1) s USING (vol, k, j, i)) h USING (vol, label)"""


@CATALOG.add("grow_from_seed", GROW_SQL)
def grow_from_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mask(spark, sf_dir, -0.1)
    seeds = m.select("vol").distinct().select("vol", *[F.lit(1).alias(c) for c in "kji"])
    return V.grow(m, seeds, SHAPE)


ERODED = erode_sql(THIN_SQL)
RECIPE_SQL = dilate_sql(f"SELECT d.vol, d.k, d.j, d.i FROM ({dilate_sql(ERODED)}) d SEMI JOIN ({THIN_SQL}) t USING (vol, k, j, i)")


@CATALOG.add("recipe_step", f"SELECT vol, k, j, i FROM ({RECIPE_SQL})")
def recipe_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.recipe(grid(spark, sf_dir), {"range": (-0.1, None), "erosion": 1, "dilate": 1}, SHAPE, {})


@CATALOG.add(
    "mask_algebra",
    f"""WITH a AS (SELECT vol, k, j, i FROM ({M_SQL})), b AS (SELECT vol, k, j, i FROM ({G_SQL}) WHERE v < 0.1)
        SELECT 'and' AS op, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'minus', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'or', * FROM (SELECT * FROM a UNION SELECT * FROM b)""",
)
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return V.algebra(g.where("v > 0"), g.where("v < 0.1"))


OUTER = f"SELECT g.vol, g.k, g.j, g.i FROM ({G_SQL}) g ANTI JOIN (SELECT vol, k, j, i FROM ({M_SQL})) m USING (vol, k, j, i)"


@CATALOG.add(
    "fill_slices",
    f"""SELECT vol, k, j, i FROM ({M_SQL}) UNION ALL SELECT vol, k, j, i FROM {label_sql(OUTER, True)} l
        ANTI JOIN (SELECT DISTINCT vol, label FROM {label_sql(OUTER, True)} WHERE j IN (0, 3) OR i IN (0, 3)) o USING (vol, label)""",
)
def fill_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.fill_slices(mask(spark, sf_dir), SHAPE, grid(spark, sf_dir).select("vol"))


@CATALOG.add("block_reduce", f"SELECT vol, CAST(k // 2 AS INTEGER) AS k, CAST(j // 2 AS INTEGER) AS j, CAST(i // 2 AS INTEGER) AS i, round(avg(v), 6) AS mean, round(max(v), 6) AS most FROM ({G_SQL}) GROUP BY 1, 2, 3, 4")
def block_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reduce_blocks(grid(spark, sf_dir), (2, 2, 2), SHAPE).withColumns({c: F.round(c, 6) for c in ("mean", "most")})


@CATALOG.add("nearest_upsample", f"SELECT vol, CAST(k * 2 + a AS INTEGER) AS k, CAST(j * 2 + b AS INTEGER) AS j, i, round(v, 6) AS v FROM ({G_SQL}), range(2) x(a), range(2) y(b)")
def nearest_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1))
    g = grid(spark, sf_dir)
    return g.withColumn("k", two("k")).withColumn("j", two("j")).select(*V.KEY, F.round("v", 6).alias("v"))
