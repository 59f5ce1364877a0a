"""Queries over coordinates, polylines and meshes. Every twelve events of a user, in order, are a path in (hours, value,
kind), named by the user and the path's number; the last may be shorter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.operators import geometry as G
from heddle.operators import graph
from heddle.session import Catalog, table

CATALOG = Catalog()
ORIGIN, SPACING, COSINES, NORMAL = [10.0, -20.0, 5.0], [2.0, 0.5, 0.5], [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], [-1.0, 0.0, 0.0]
E_SQL = "SELECT *, user_id * 1000000 + m // 12 AS path, CAST(m % 12 + 1 AS INTEGER) AS n, epoch(ts - TIMESTAMP '2024-01-01') / 3600.0 AS x FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS m FROM events)"
P_SQL = f"SELECT path, n, x, value AS y, CAST(event_id % 7 AS DOUBLE) AS z FROM ({E_SQL})"
SEG_SQL = f"""SELECT path, n, x AS ax, y AS ay, z AS az, nx AS bx, ny AS by_, nz AS bz, sum(coalesce(d, 0)) OVER (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM ({P_SQL}) WINDOW w AS (PARTITION BY path ORDER BY n)) QUALIFY nx IS NOT NULL"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("m"), (micros / 1000000.0 / 3600.0).alias("x"), F.col("value").alias("y"))
    return e.select((F.col("user_id") * 1000000 + F.floor(F.col("m") / 12)).alias("path"), (F.col("m") % 12 + 1).alias("n"), "event_id", "x", "y")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("path", "n", "x", "y", (F.col("event_id") % 7).cast("double").alias("z"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.operators.sequences import arc_length

    w = Window.partitionBy("path").orderBy("n")
    d = arc_length(paths(spark, sf_dir), "path", ["n"], ["x", "y", "z"])
    return d.select("path", "n", "s", *[F.col(c).alias(f"a{c}") for c in "xyz"], *[F.lead(c).over(w).alias(f"b{c}") for c in "xyz"]).where("bx is not null")


@CATALOG.add(
    "affine_roundtrip",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(10.0 - 2.0 * k, 6) AS px, round(-20.0 + 0.5 * i, 6) AS py, round(5.0 - 0.5 * j, 6) AS pz, round(k, 6) AS k, round(j, 6) AS j, round(i, 6) AS i, round(10.0 - 2.0 * k, 6) AS gx, round(5.0 - 0.5 * j, 6) AS gy, round(20.0 - 0.5 * i, 6) AS gz
       FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS k, l_tax AS j, l_discount AS i FROM lineitem)""",
)
def affine_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("k"), F.col("l_tax").alias("j"), F.col("l_discount").alias("i"))
    p = G.to_patient([F.col(c) for c in "kji"], ORIGIN, SPACING, COSINES, NORMAL)
    d = d.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(f"p{n}") for c, n in zip(p, "xyz")])
    q = [F.col(f"p{n}") for n in "xyz"]
    back, gltf = G.to_voxel(q, ORIGIN, SPACING, COSINES, NORMAL), G.to_gltf(q)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(f"p{n}") for c, n in zip(q, "xyz")], *[F.round(c, 6).alias(n) for c, n in zip(back, "kji")], *[F.round(c, 6).alias(f"g{n}") for c, n in zip(gltf, "xyz")])


@CATALOG.add("grid_index", "SELECT p_partkey, CAST(10 + p_size * 2 + 0.5 AS DOUBLE) AS full_index, CAST(p_size AS DOUBLE) AS reduced FROM part")
def grid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = G.to_full(F.col("p_size"), 10, 2)
    return table(spark, sf_dir, "part").select("p_partkey", full.alias("full_index"), G.to_reduced(full, 10, 2).alias("reduced"))


NEAR_SQL = f"""WITH s AS ({SEG_SQL}), p AS (SELECT path, event_id, x AS px, value AS py, CAST(event_id % 5 AS DOUBLE) AS pz FROM ({E_SQL})),
  j AS (SELECT *, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az) AS l2 FROM p JOIN s USING (path)),
  t AS (SELECT *, CASE WHEN l2 > 0 THEN ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay) + (pz - az) * (bz - az)) / l2 ELSE 0 END AS raw, max(n) OVER (PARTITION BY path) AS hi FROM j),
  u AS (SELECT *, greatest(0, least(1, raw)) AS t FROM t),
  d AS (SELECT *, sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (by_ - ay)), 2) + pow(pz - (az + t * (bz - az)), 2)) AS d FROM u)
  SELECT path, event_id, d, s + t * sqrt(l2) AS s, (n = 1 AND raw < 0) OR (n = hi AND raw > 1) AS tip FROM d QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, n) = 1"""


def feet(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(spark, sf_dir).select("path", "event_id", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("event_id") % 5).cast("double").alias("pz"))
    return G.nearest_segment(p, segments(spark, sf_dir), ["path", "event_id"])


@CATALOG.add("nearest_segment", f"SELECT event_id, round(d, 5) AS distance, round(s, 4) AS s, tip FROM ({NEAR_SQL})")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feet(spark, sf_dir).select("event_id", F.round("distance", 5).alias("distance"), F.round("s", 4).alias("s"), "tip")


@CATALOG.add("sleeve", f"SELECT event_id FROM ({NEAR_SQL}) WHERE d <= 20 AND NOT tip")
def sleeve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feet(spark, sf_dir).where("distance <= 20 and not tip").select("event_id")


STATION_SQL = f"""SELECT path, CAST(floor(s / 50) AS BIGINT) AS station, count(*) AS n, 2.0 + count(*) % 3 AS r FROM ({NEAR_SQL}) WHERE d <= 20 GROUP BY 1, 2"""


@CATALOG.add("stations", f"SELECT path, station, n, round(n * 0.25 / 50, 6) AS area, round(sqrt(n * 0.25 / 50 / pi() + r * r), 6) AS outer_radius, round(sqrt(n * 0.25 / 50 / pi() + r * r) - r, 6) AS thickness FROM ({STATION_SQL})")
def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.operators.measures import wall

    n = feet(spark, sf_dir).where("distance <= 20").groupBy("path", F.floor(F.col("s") / 50).alias("station")).agg(F.count(F.lit(1)).alias("n"))
    d = wall(n.withColumn("r", 2.0 + F.col("n") % 3), "n", "r", 0.25, 50.0)
    return d.select("path", "station", "n", *[F.round(c, 6).alias(c) for c in ("area", "outer_radius", "thickness")])


@CATALOG.add(
    "subdivide",
    f"""SELECT path, n, t, round(ax + (bx - ax) * t / m, 6) AS x, round(ay + (by_ - ay) * t / m, 6) AS y, round(az + (bz - az) * t / m, 6) AS z
        FROM (SELECT *, unnest(range(m)) AS t FROM (SELECT *, CAST(greatest(1, ceil(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2) + pow(bz - az, 2)) / 25)) AS BIGINT) AS m FROM ({SEG_SQL})))""",
)
def subdivide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.subdivide(segments(spark, sf_dir), 25.0).withColumns({c: F.round(c, 6) for c in "xyz"}).withColumn("t", F.col("t").cast("long"))


def _cr_sql() -> str:
    mix = lambda a, b, ta, tb: f"(({tb}) - t) / (({tb}) - ({ta})) * ({a}) + (t - ({ta})) / (({tb}) - ({ta})) * ({b})"
    cols = []
    for c in "xyz":
        a1, a2, a3 = mix(f"{c}0", c, "0", "ta"), mix(c, f"{c}2", "ta", "ta + tb"), mix(f"{c}2", f"{c}3", "ta + tb", "ta + tb + tc")
        b1, b2 = mix(a1, a2, "0", "ta + tb"), mix(a2, a3, "ta", "ta + tb + tc")
        cols.append(f"round({mix(b1, b2, 'ta', 'ta + tb')}, 5) AS {c}")
    gap = lambda a, b: f"greatest(sqrt(sqrt(pow(x{b} - x{a}, 2) + pow(y{b} - y{a}, 2) + pow(z{b} - z{a}, 2))), 1e-9)"
    ends = ", ".join(f"coalesce(lag({c}) OVER w, 2 * {c} - lead({c}) OVER w) AS {c}0, lead({c}) OVER w AS {c}2, coalesce(lead({c}, 2) OVER w, 2 * lead({c}) OVER w - {c}) AS {c}3" for c in "xyz")
    return f"""WITH p AS (SELECT path, n, x, y, z, {ends} FROM ({P_SQL}) WINDOW w AS (PARTITION BY path ORDER BY n)),
      g AS (SELECT *, {gap('0', '')} AS ta, {gap('', '2')} AS tb, {gap('2', '3')} AS tc FROM p WHERE x2 IS NOT NULL),
      t AS (SELECT *, ta + tb * m / 4 AS t FROM (SELECT *, CAST(unnest(range(4)) AS INTEGER) AS m FROM g))
      SELECT path, n, m, {', '.join(cols)} FROM t"""


@CATALOG.add("catmull_rom", _cr_sql())
def catmull_rom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.catmull_rom(paths(spark, sf_dir), 4, ["n"]).withColumns({c: F.round(c, 5) for c in "xyz"})


@CATALOG.add("piecewise_lookup", "SELECT p_partkey, round(CASE WHEN p_size <= 5 THEN 12 WHEN p_size <= 20 THEN 12 + (2.2 - 12) * (p_size - 5) / 15.0 WHEN p_size <= 40 THEN 2.2 + (10 - 2.2) * (p_size - 20) / 20.0 ELSE 10 END, 6) AS r FROM part")
def piecewise_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.lookup(F.col("p_size"), [(5, 12.0), (20, 2.2), (40, 10.0)]), 6).alias("r"))


V_SQL = "SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {p}{c}" for i, (p, c) in enumerate((p, c) for p in "abc" for c in "xyz")) + " FROM embeddings"


@CATALOG.add("mesh_volume", f"SELECT label, round(sum(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6, 6) AS volume FROM ({V_SQL.replace('AS by,', 'AS by_,')}) GROUP BY label")
def mesh_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]
    t = table(spark, sf_dir, "embeddings").select("label", *[F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate(names)])
    return G.signed_volume(t, "label").withColumn("volume", F.round("volume", 6))


@CATALOG.add("mesh_edges", "SELECT DISTINCT o_orderstatus, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT o_orderstatus, o_orderkey % 50 AS a, o_custkey % 50 AS b FROM orders UNION ALL SELECT o_orderstatus, o_custkey % 50, o_orderkey % 17 FROM orders UNION ALL SELECT o_orderstatus, o_orderkey % 17, o_orderkey % 50 FROM orders)")
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_orderkey") % 50).alias("p"), (F.col("o_custkey") % 50).alias("q"), (F.col("o_orderkey") % 17).alias("r"))
    return G.unique_edges(f, "o_orderstatus", ["p", "q", "r"])


def _taubin_sql(rounds: int) -> str:
    edges = "SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, l_partkey % 97 + 1 AS b FROM lineitem UNION ALL SELECT l_partkey % 97 + 1, l_partkey FROM lineitem) WHERE a <> b"
    sql, n = f"WITH e AS ({edges}), n0 AS (SELECT p_partkey AS node, p_retailprice AS x FROM part)", 0
    for _ in range(rounds):
        for f in (0.5, -0.53):
            n += 1
            sql += f", m{n} AS (SELECT a, avg(x) AS m FROM e JOIN n{n - 1} ON b = node GROUP BY a), n{n} AS (SELECT node, coalesce(x + {f} * (m - x), x) AS x FROM n{n - 1} LEFT JOIN m{n} ON a = node)"
    return sql + f" SELECT node, round(x, 4) AS x FROM n{n}"


@CATALOG.add("taubin", _taubin_sql(2))
def taubin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_partkey") % 97 + 1).alias("b")).where("a <> b").distinct()
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("x"))
    return graph.taubin(n, e, ["x"], 2).withColumn("x", F.round("x", 4))


@CATALOG.add(
    "scene_boxes",
    """WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 3 THEN p_partkey // 3 END AS parent, CAST(p_size AS DOUBLE) AS x FROM part), r AS (
       SELECT node, 0 AS depth, x FROM n WHERE parent IS NULL UNION ALL SELECT n.node, r.depth + 1, r.x * 0.5::DOUBLE + n.x FROM n JOIN r ON n.parent = r.node) SELECT node, depth, round(x, 6) AS x FROM r""",
)
def scene_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = table(spark, sf_dir, "part").select(k.alias("node"), F.when(k > 3, F.floor(k / 3)).alias("parent"), (F.col("p_size") * 1.0).alias("x"))
    return graph.descend(n, ["x"], [F.col("p_x") * 0.5 + F.col("c_x")]).withColumn("x", F.round("x", 6))


@CATALOG.add(
    "colour_functions",
    """SELECT s_suppkey, r, g, b, round(CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END, 6) AS linear_r, 0.299 * r + 0.587 * g + 0.114 * b > 165 AS light
       FROM (SELECT s_suppkey, CAST(s_suppkey * 7 % 256 AS INTEGER) AS r, CAST(s_suppkey * 11 % 256 AS INTEGER) AS g, CAST(s_suppkey * 13 % 256 AS INTEGER) AS b FROM supplier)""",
)
def colour_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    r, g, b = X.rgb(F.concat(F.lit("#"), two(k * 7 % 256), two(k * 11 % 256), two(k * 13 % 256)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", r.alias("r"), g.alias("g"), b.alias("b"), F.round(X.linear(r), 6).alias("linear_r"), (0.299 * r + 0.587 * g + 0.114 * b > 165).alias("light"))


@CATALOG.add("parallel_frames")
def parallel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form: a fold along each path."""
    from heddle.operators import paths as folds

    return folds.frames(paths(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("nx", "ny", "nz")})


@CATALOG.add(
    "shear_angle",
    """SELECT path, round(degrees(acos(least(1.0, abs(dx * 0.6 + dy * 0.8) / greatest(sqrt(dx * dx + dy * dy + dz * dz), 1e-9)))), 4) AS angle FROM (
       SELECT path, arg_max(x, n) - arg_min(x, n) AS dx, arg_max(y, n) - arg_min(y, n) AS dy, arg_max(z, n) - arg_min(z, n) AS dz FROM (""" + P_SQL + ") GROUP BY path)",
)
def shear_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the way from the first to the last point and the normal (0.6, 0.8, 0)."""
    d = paths(spark, sf_dir).groupBy("path").agg(*[(F.max_by(c, "n") - F.min_by(c, "n")).alias(f"d{c}") for c in "xyz"])
    way = [F.col(f"d{c}") for c in "xyz"]
    along = F.abs(G.dot(way, [F.lit(0.6), F.lit(0.8), F.lit(0.0)])) / F.greatest(G.norm(way), F.lit(1e-9))
    return d.select("path", F.round(F.degrees(F.acos(F.least(F.lit(1.0), along))), 4).alias("angle"))


@CATALOG.add("tube_mesh", f"SELECT path, n, a, round(x + 2 * cos(a * pi() / 4), 6) AS x, round(y + 2 * sin(a * pi() / 4), 6) AS y, z FROM ({P_SQL}), range(8) t(a)")
def tube_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of eight corners around each point."""
    d = paths(spark, sf_dir).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    turn = F.col("a") * F.lit(3.141592653589793) / 4
    return d.select("path", "n", "a", F.round(F.col("x") + 2 * F.cos(turn), 6).alias("x"), F.round(F.col("y") + 2 * F.sin(turn), 6).alias("y"), "z")


@CATALOG.add("camera_projection", f"SELECT path, n, round((x * 0.8 - y * 0.6) / (z + 10), 6) AS u, round((x * 0.6 + y * 0.8) / (z + 10), 6) AS v FROM ({P_SQL})")
def camera_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = [F.col(c) for c in "xyz"]
    right, up = [F.lit(0.8), F.lit(-0.6), F.lit(0.0)], [F.lit(0.6), F.lit(0.8), F.lit(0.0)]
    depth = F.col("z") + 10
    return paths(spark, sf_dir).select("path", "n", F.round(G.dot(p, right) / depth, 6).alias("u"), F.round(G.dot(p, up) / depth, 6).alias("v"))
