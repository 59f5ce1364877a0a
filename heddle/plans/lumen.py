"""Courses through volumes of 16 x 16 x 16 voxels (64 embeddings each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import lumen as L
from heddle.session import Catalog, table

from .bricks import V_SQL, values

CATALOG = Catalog()
SHAPE, SPACING, LO = (16, 16, 16), (2.0, 1.0, 1.5), 0.02
MEAN_SQL = f"""SELECT p.vol, p.k, p.j, p.i FROM ({V_SQL}) p, (VALUES (-1), (0), (1)) x(dj), (VALUES (-1), (0), (1)) y(di), ({V_SQL}) q
  WHERE p.vol = q.vol AND p.k = q.k AND q.j = greatest(0, least(15, p.j + dj)) AND q.i = greatest(0, least(15, p.i + di)) GROUP BY ALL HAVING sum(q.v) / 9 > {LO}"""


def way_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three points a volume, from its vectors' ids."""
    vols = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 64).alias("vol")).agg(F.count(F.lit(1)).alias("m")).where("m = 64").select("vol")
    point = lambda n, k, j, i: F.struct(F.lit(n).alias("n"), k.cast("double").alias("k"), j.cast("double").alias("j"), i.cast("double").alias("i"))
    v = F.col("vol")
    three = F.array(point(0, F.lit(1), 3 + v % 5, 4 + v % 3), point(1, F.lit(8), 6 + v % 7, F.lit(9)), point(2, F.lit(13), F.lit(11), 12 - v % 4))
    return vols.select("vol", F.explode(three).alias("p")).select("vol", "p.*")


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).join(way_points(spark, sf_dir).select("vol").distinct(), "vol", "left_semi")


PIECE_SQL = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT *, j * 16 + i AS p FROM ({MEAN_SQL}) WHERE vol IN (SELECT vec_id // 64 FROM embeddings GROUP BY 1 HAVING count(*) = 64)),
  r AS (SELECT vol, k, p, p AS q FROM m UNION SELECT r.vol, r.k, r.p, n.p FROM r JOIN m o ON o.vol = r.vol AND o.k = r.k AND o.p = r.q
    JOIN m n ON n.vol = o.vol AND n.k = o.k AND abs(n.j - o.j) + abs(n.i - o.i) = 1),
  l AS (SELECT vol, k, p, min(q) AS piece FROM r GROUP BY ALL)"""


@CATALOG.add("lumen_pieces", f"{PIECE_SQL} SELECT vol, CAST(k AS INTEGER) AS s, CAST(piece AS BIGINT) AS piece, count(*) AS area, round(avg(p // 16), 6) AS a, round(avg(p % 16), 6) AS b FROM l GROUP BY ALL HAVING count(*) >= 4")
def lumen_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.pieces(complete(spark, sf_dir), "k", LO, None)
    piece = F.shiftright("piece", 32) * 16 + F.col("piece").bitwiseAND(F.lit(0xFFFFFFFF))
    return found.select("vol", "s", piece.alias("piece"), "area", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@CATALOG.add("lumen_course")
def lumen_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form: each slice's choice depends on the choice before."""
    found = L.pieces(complete(spark, sf_dir), "k", LO, None)
    out = L.course(L.follow(found, way_points(spark, sf_dir).where("n = 1"), "k", 12.0, SPACING), "k", 5, SPACING)
    return out.withColumns({c: F.round(c, 6) for c in ("k", "j", "i", "s_mm", "radius")})


@CATALOG.add("lumen_summary")
def lumen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.summary(lumen_course(spark, sf_dir))


WINDOW, SEARCH = 4.0, 2.0
POINT_SQL = """w AS (SELECT vec_id // 64 AS vol FROM embeddings GROUP BY 1 HAVING count(*) = 64),
  p0 AS (SELECT vol, 1 AS leg, 1.0::DOUBLE AS k, (3 + vol % 5)::DOUBLE AS j, (4 + vol % 3)::DOUBLE AS i FROM w UNION ALL SELECT vol, 2, 8, 6 + vol % 7, 9 FROM w UNION ALL SELECT vol, 3, 13, 11, 12 - vol % 4 FROM w),
  p1 AS (SELECT *, lead(k) OVER o AS k2, lead(j) OVER o AS j2, lead(i) OVER o AS i2 FROM p0 WINDOW o AS (PARTITION BY vol ORDER BY leg)),
  p2 AS (SELECT *, CAST(greatest(1, coalesce(ceil(sqrt(pow((k2 - k) * 2, 2) + pow(j2 - j, 2) + pow((i2 - i) * 1.5, 2)) / 3), 1)) AS INTEGER) AS m FROM p1),
  p AS (SELECT vol, leg, t, coalesce(k + (k2 - k) * t / m, k) AS k, coalesce(j + (j2 - j) * t / m, j) AS j, coalesce(i + (i2 - i) * t / m, i) AS i FROM (SELECT *, unnest(range(m)) AS t FROM p2))"""
MANUAL_SQL = f"""WITH RECURSIVE {POINT_SQL},
  c AS MATERIALIZED (SELECT vol, leg, t, round_even(k, 0)::INT AS s, round_even(j, 0)::INT AS pa, round_even(i, 0)::INT AS pb FROM p),
  win AS MATERIALIZED (SELECT c.*, v.j AS a, v.i AS b, v.v FROM c JOIN ({V_SQL}) v ON v.vol = c.vol AND v.k = c.s AND v.j BETWEEN pa - 4 AND pa + 4 AND v.i BETWEEN pb - 2 AND pb + 2),
  box AS (SELECT vol, leg, t, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM win GROUP BY ALL),
  m AS MATERIALIZED (SELECT x.vol, x.leg, x.t, x.pa, x.pb, x.a, x.b FROM win x JOIN box USING (vol, leg, t), (VALUES (-1), (0), (1)) y(da), (VALUES (-1), (0), (1)) z(db), win o
    WHERE o.vol = x.vol AND o.leg = x.leg AND o.t = x.t AND o.a = greatest(a0, least(a1, x.a + da)) AND o.b = greatest(b0, least(b1, x.b + db)) GROUP BY ALL HAVING sum(o.v) / 9 > {LO}),
  near AS (SELECT *, sqrt(pow(a - pa, 2) + pow((b - pb) * 1.5, 2)) AS d FROM m QUALIFY row_number() OVER (PARTITION BY vol, leg, t ORDER BY sqrt(pow(a - pa, 2) + pow((b - pb) * 1.5, 2)), a, b) = 1),
  r AS (SELECT vol, leg, t, a, b FROM near WHERE d <= {SEARCH} UNION SELECT m.vol, m.leg, m.t, m.a, m.b FROM r JOIN m USING (vol, leg, t) WHERE abs(m.a - r.a) + abs(m.b - r.b) = 1),
  g AS (SELECT vol, leg, t, count(*) AS cells FROM r GROUP BY ALL),
  q AS (SELECT p.*, coalesce(cells, 0) AS cells, row_number() OVER o - 1 AS n, lead(k) OVER o AS kn, lag(k) OVER o AS kp, lead(j) OVER o AS jn, lag(j) OVER o AS jp, lead(i) OVER o AS in_, lag(i) OVER o AS ip
    FROM p LEFT JOIN g USING (vol, leg, t) WINDOW o AS (PARTITION BY vol ORDER BY leg, t)),
  d AS (SELECT *, (coalesce(kn, k) - coalesce(kp, k)) * 2 AS dk, coalesce(jn, j) - coalesce(jp, j) AS dj, (coalesce(in_, i) - coalesce(ip, i)) * 1.5 AS di FROM q),
  e AS (SELECT *, sqrt(cells * 1.5 * abs(dk) / sqrt(dk * dk + dj * dj + di * di) / pi()) AS radius, coalesce(sqrt(pow((k - kp) * 2, 2) + pow(j - jp, 2) + pow((i - ip) * 1.5, 2)), 0) AS step FROM d)
  SELECT vol, CAST(n AS INTEGER) AS n, round(k, 6) AS k, round(j, 6) AS j, round(i, 6) AS i, round(sum(step) OVER (PARTITION BY vol ORDER BY n), 6) AS s_mm, round(radius, 6) AS radius, radius <= 0 AS gap FROM e"""


@CATALOG.add("lumen_by_points", MANUAL_SQL)
def lumen_by_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.by_points(complete(spark, sf_dir), way_points(spark, sf_dir), "k", LO, None, SHAPE, 3.0, SPACING, WINDOW, SEARCH)
    return d.withColumns({c: F.round(c, 6) for c in ("k", "j", "i", "s_mm", "radius")})
