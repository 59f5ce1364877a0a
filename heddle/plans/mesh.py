"""Meshes around the paths of events and around suppliers. The SQL of volumes uses closed formulas, not the meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import geometry as G
from heddle.operators import mesh as M
from heddle.plans.geometry import P_SQL, paths
from heddle.session import Catalog, table

CATALOG = Catalog()


def upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with level rings: the normal is the first axis, the binormal the second."""
    axes = {"nx": 1.0, "ny": 0.0, "nz": 0.0, "bx": 0.0, "by_": 1.0, "bz": 0.0}
    return paths(spark, sf_dir).withColumns({c: F.lit(v) for c, v in axes.items()})


@CATALOG.add(
    "tube_faces",
    f"""WITH p AS (SELECT path, count(*) AS rows FROM ({P_SQL}) GROUP BY path HAVING count(*) > 1), j AS (SELECT unnest(range(8)) AS j)
        SELECT path, concat_ws(',', r * 8 + j, r * 8 + (j + 1) % 8, (r + 1) * 8 + (j + 1) % 8, (r + 1) * 8 + j) AS corners FROM (SELECT *, unnest(range(rows - 1)) AS r FROM p), j
        UNION ALL SELECT path, concat_ws(',', rows * 8, (j + 1) % 8, j) FROM p, j
        UNION ALL SELECT path, concat_ws(',', rows * 8 + 1, (rows - 1) * 8 + j, (rows - 1) * 8 + (j + 1) % 8) FROM p, j""",
)
def tube_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, faces = M.tube(upright(spark, sf_dir), "path", "n", 8, F.lit(2.0))
    return faces.select("path", F.array_join("corners", ",").alias("corners"))


@CATALOG.add(
    "tube_volumes",
    f"""SELECT path, round(a * 4 * h, 4) + 0.0 AS tube, round(a * (4 - 2.25) * h, 4) + 0.0 AS sleeve FROM (SELECT path, 6 * sin(2 * pi() / 12) AS a, arg_max(z, n) - arg_min(z, n) AS h FROM ({P_SQL}) GROUP BY path HAVING count(*) > 1)""",
)
def tube_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed volumes of a tube of radius 2 and of the wall from 1.5 to 2 around it, twelve sides each."""
    frames = upright(spark, sf_dir)
    volume = lambda triangles, name: G.signed_volume(triangles, "path").select("path", (F.round(-F.col("volume"), 4) + 0.0).alias(name))
    tube, wall = M.tube_triangles(frames, "path", "n", 12, F.lit(2.0)), M.sleeve_triangles(frames, "path", "n", 12, F.lit(2.0), F.lit(1.5))
    return volume(tube, "tube").join(volume(wall, "sleeve"), "path")


@CATALOG.add(
    "ellipsoid_volumes",
    """WITH rings AS (SELECT i, 10 * sin(2 * pi() / 20) * pow(sin(i * pi() / 10), 2) AS area, cos(i * pi() / 10) AS at FROM range(11) t(i)),
            unit AS (SELECT sum((a.at - b.at) / 3 * (a.area + b.area + sqrt(a.area * b.area))) AS v FROM rings a JOIN rings b ON b.i = a.i + 1)
       SELECT s_suppkey, round(v * (1 + s_suppkey % 3) * (2 + s_suppkey % 5) * 0.5, 4) AS volume FROM supplier, unit""",
)
def ellipsoid_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    triangles = M.ellipsoid_triangles(table(spark, sf_dir, "supplier"), "s_suppkey", [k % 7, k % 11, F.lit(3)], [1 + k % 3, 2 + k % 5, F.lit(0.5)], 20, 10)
    return G.signed_volume(triangles, "s_suppkey").select("s_suppkey", F.round("volume", 4).alias("volume"))
