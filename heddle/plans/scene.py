"""Scenes of 64 nodes, over 30 levels deep, made of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import scene as G
from heddle.session import Catalog, table

CATALOG = Catalog()
N_SQL = """n AS MATERIALIZED (SELECT c_custkey // 64 AS scene, CAST(c_custkey % 64 AS INTEGER) AS node, c_custkey % 64 AS r, c_custkey,
    radians(c_custkey % 12 * 31 + 7) AS a, 0.913 + c_nationkey % 3 * 0.0877 AS s, [c_nationkey % 5 - 2, c_acctbal / 9973, 0.5] AS t FROM customer),
  m AS MATERIALIZED (SELECT scene, node, CASE WHEN r = 0 THEN NULL WHEN r % 2 = 1 THEN node - 1 ELSE node - 2 END AS parent,
    [cos(a) * s, -sin(a), 0, t[1], sin(a) * s, cos(a), 0, t[2], 0, 0, 1, t[3], 0, 0, 0, 1]::DOUBLE[] AS m, CASE WHEN r % 2 = 1 THEN [-1, -1, 0]::DOUBLE[] END AS low, [1, 2, 0.5 * (r % 5)]::DOUBLE[] AS high FROM n),
  p AS MATERIALIZED (SELECT m.* REPLACE (CASE WHEN u.node IS NULL THEN NULL ELSE m.parent END AS parent) FROM m LEFT JOIN m u ON u.scene = m.scene AND u.node = m.parent)"""
W_SQL = f"""WITH RECURSIVE {N_SQL},
  w AS (SELECT scene, node, m, low, high, [node] AS line FROM p WHERE parent IS NULL UNION ALL
    SELECT p.scene, p.node, [list_sum([w.m[x // 4 * 4 + k + 1] * p.m[k * 4 + x % 4 + 1] for k in range(4)]) for x in range(16)], p.low, p.high, list_append(w.line, p.node) FROM w JOIN p ON p.scene = w.scene AND p.parent = w.node)"""
CORNER_SQL = """c AS (SELECT scene, line, [m[1] * x + m[2] * y + m[3] * z + m[4], m[5] * x + m[6] * y + m[7] * z + m[8], m[9] * x + m[10] * y + m[11] * z + m[12]] AS q
    FROM (SELECT *, unnest([low[1], high[1]]) AS x FROM w WHERE low IS NOT NULL) a, LATERAL (SELECT unnest([low[2], high[2]]) AS y), LATERAL (SELECT unnest([low[3], high[3]]) AS z)),
  e AS (SELECT scene, unnest(line) AS node, q FROM c)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    r, a = F.col("c_custkey") % 64, F.radians(F.col("c_custkey") % 12 * 31 + 7)
    number = lambda *v: F.array(*[(x if not isinstance(x, (int, float)) else F.lit(x)).cast("double") for x in v])
    turn = number(0.0, 0.0, F.sin(a / 2), F.cos(a / 2))
    size = number(F.lit(0.913) + F.col("c_nationkey") % 3 * 0.0877, 1.0, 1.0)
    move = number(F.col("c_nationkey") % 5 - 2, F.col("c_acctbal") / 9973, 0.5)
    up = F.when(r == 0, F.lit(None)).when(r % 2 == 1, r - 1).otherwise(r - 2)
    box = F.when(r % 2 == 1, number(-1.0, -1.0, 0.0))
    return c.select(F.floor(F.col("c_custkey") / 64).alias("scene"), r.cast("int").alias("node"), up.cast("int").alias("parent"), G.placed(move, turn, size).alias("matrix"), box.alias("low"), number(1.0, 2.0, 0.5 * (r % 5)).alias("high"))


@CATALOG.add("scene_matrices", f"{W_SQL} SELECT scene, node, CAST(len(line) - 1 AS INTEGER) AS depth, line[1] AS root, " + ", ".join(f"round(m[{i + 1}], 5) AS m{i}" for i in range(12)) + " FROM w")
def scene_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.world(nodes(spark, sf_dir))
    return d.select("scene", "node", "depth", "root", *[F.round(F.get("matrix", F.lit(i)), 5).alias(f"m{i}") for i in range(12)])


@CATALOG.add(
    "scene_unions",
    f"{W_SQL}, {CORNER_SQL} SELECT w.scene, w.node, {', '.join(f'round(min(q[{i + 1}]), 5) AS low_{i}, round(max(q[{i + 1}]), 5) AS high_{i}' for i in range(3))} FROM w LEFT JOIN e ON e.scene = w.scene AND e.node = w.node GROUP BY ALL",
)
def scene_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.boxes(G.world(nodes(spark, sf_dir)))
    return d.select("scene", "node", *[F.round(F.get(e, F.lit(i)), 5).alias(f"{e}_{i}") for i in range(3) for e in ("low", "high")])
