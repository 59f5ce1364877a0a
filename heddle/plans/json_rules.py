"""Viewer documents made of orders and their lines, with faults that follow from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import json_rules as J
from heddle.session import Catalog, table

CATALOG = Catalog()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and json: an order's lines are its structures, its key sets what else the document says."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("l_returnflag"))
    n = F.col("l_linenumber")
    opacity = F.when(F.col("l_partkey") % 11 == 0, F.lit("true")).when(F.col("l_partkey") % 7 == 0, F.lit("1.5")).otherwise(F.lit("0.5"))
    key = F.when((n == 3) & (F.col("l_suppkey") % 5 == 0), F.lit("s1")).otherwise(F.concat(F.lit("s"), n))
    part = F.concat(F.lit('{"k": "'), key, F.lit('", "n": "'), F.col("l_returnflag"), F.lit('", "_nota": {"a": 9}, "a": '), opacity, F.when(F.col("l_suppkey") % 3 == 0, F.lit(', "con": "s2"')).otherwise(F.lit("")), F.lit("}"))
    held = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", part.alias("x")))).alias("x"))
    o = F.col("l_orderkey")
    points = F.array_join(F.transform(F.sequence(F.lit(1), (o % 4 + 1).cast("int")), lambda i: F.concat(F.lit("["), i, F.lit(", 0, 0.5]"))), ", ")
    text = F.concat(
        F.lit('{"estructuras": ['), F.array_join(F.col("x.x"), ", "), F.lit('], "ruta": {"puntos": ['), points, F.lit('], "estrechez": {"desde": 0, "hasta": '), o % 3, F.lit(', "luz_normal": [1, 2]}}, "vistas": {"a": {"dir": [0, 0, 1], "radio": '),
        F.when(o % 5 == 0, F.lit("0")).otherwise(F.lit("2")), F.lit('}}, "vista_inicial": "'), F.when(o % 6 == 0, F.lit("b")).otherwise(F.lit("a")), F.lit('", "secuencias": {"q": [{"t": "x", "luz": [1]'), F.when(o % 9 == 0, F.lit("")).otherwise(F.lit(', "pared": [2]')), F.lit("}]}"),
        F.when(o % 13 == 0, F.lit(",")).otherwise(F.lit("}")),
    )
    return held.select(o.cast("string").alias("id"), text.alias("json"))


SQL = """
WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS r, l_linenumber AS n, l_partkey, l_suppkey,
    CASE WHEN l_linenumber = 3 AND l_suppkey % 5 = 0 THEN 's1' ELSE 's' || l_linenumber END AS k FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
  d AS (SELECT DISTINCT o, o % 4 + 1 AS points, o % 3 AS last FROM l), good AS (SELECT * FROM d WHERE o % 13 <> 0)
SELECT CAST(o AS VARCHAR) AS id, path, rule, value FROM (
  SELECT o, '' AS path, 'json' AS rule, '' AS value FROM d WHERE o % 13 = 0
  UNION ALL SELECT o, 'estructuras[' || r || '].a', 'structure opacity', CASE WHEN l_partkey % 11 = 0 THEN 'true' ELSE '1.5' END FROM l JOIN good USING (o) WHERE l_partkey % 11 = 0 OR l_partkey % 7 = 0
  UNION ALL SELECT o, 'estructuras[' || r || '].k', 'structure key', 's1' FROM l JOIN good USING (o) WHERE k = 's1' AND n = 3 AND EXISTS (FROM l f WHERE f.o = l.o AND f.n = 1)
  UNION ALL SELECT o, 'estructuras[' || r || '].con', 'structure with', 's2' FROM l JOIN good USING (o) WHERE l_suppkey % 3 = 0 AND NOT EXISTS (FROM l f WHERE f.o = l.o AND f.k = 's2')
  UNION ALL SELECT o, 'ruta.puntos', 'course', NULL FROM good WHERE points < 2
  UNION ALL SELECT o, 'ruta.estrechez', 'narrow span', NULL FROM good WHERE last <= 0
  UNION ALL SELECT o, 'ruta.estrechez.desde', 'narrow from', '0' FROM good WHERE points < 2
  UNION ALL SELECT o, 'ruta.estrechez.hasta', 'narrow to', CAST(last AS VARCHAR) FROM good WHERE points < 2 OR last > points - 1
  UNION ALL SELECT o, 'ruta.estrechez.luz_normal', 'narrow light', '2' FROM good WHERE last + 1 <> 2
  UNION ALL SELECT o, 'vistas.a.radio', 'view radius', '0' FROM good WHERE o % 5 = 0
  UNION ALL SELECT o, 'vista_inicial', 'first view', 'b' FROM good WHERE o % 6 = 0
  UNION ALL SELECT o, 'secuencias.q[0]', 'step', NULL FROM good WHERE o % 9 = 0)
"""


@CATALOG.add("viewer_documents", SQL)
def viewer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the viewer's rules find; where a document isn't JSON only that is said (the parser's own words are left out)."""
    d = J.checked(documents(spark, sf_dir), J.VIEWER)
    return d.withColumn("value", F.when(F.col("rule") == "json", F.lit("")).otherwise(F.col("value")))
