"""Queries over series: orders stand for series, their lines for slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.operators import series as S
from heddle.session import Catalog, table

CATALOG = Catalog()
DIFFS = "SELECT *, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS d FROM lineitem"
SPACING_SQL = f"""
WITH d AS ({DIFFS}), g AS (
  SELECT l_orderkey, count(*) AS n, median(d) FILTER (d > 0.001) AS step, max(l_quantity) - min(l_quantity) AS coverage,
         count(*) FILTER (d <= 0.001) AS duplicates FROM d GROUP BY l_orderkey
), x AS (
  SELECT g.*, (SELECT count(*) FROM d WHERE d.l_orderkey = g.l_orderkey AND d > 0.001 AND d > 1.5 * step) AS gaps,
         (SELECT count(*) FROM d WHERE d.l_orderkey = g.l_orderkey AND d > 0.001 AND abs(d - step) > greatest(0.01 * step, 0.02)) AS off FROM g
)
SELECT l_orderkey, n, round(step, 6) AS step, round(coverage, 6) AS coverage, duplicates, CAST(gaps AS INTEGER) AS gaps,
       CASE WHEN n < 2 THEN '-' WHEN duplicates > 0 THEN duplicates || ' posiciones repetidas' WHEN gaps > 0 THEN 'irregular (' || gaps || ' huecos)'
            WHEN off > 0 THEN 'irregular' ELSE 'uniforme' END AS verdict FROM x
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@CATALOG.add("step_gaps", SPACING_SQL)
def step_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.spacing(lines(spark, sf_dir), "l_orderkey", "l_quantity")
    return out.select("l_orderkey", "n", F.round("step", 6).alias("step"), F.round("coverage", 6).alias("coverage"), "duplicates", "gaps", "verdict")


@CATALOG.add(
    "series_summary",
    """SELECT l_orderkey, count(*) AS n, list(l_partkey ORDER BY l_linenumber, l_partkey, l_shipdate)[1] AS first_part, list(l_shipdate ORDER BY l_linenumber, l_partkey, l_shipdate)[1] AS first_date,
       min(strftime(l_shipdate, '%H%M%S')) AS least_clock, round(max(l_extendedprice) - min(l_extendedprice), 2) AS spread, count(*) < 3 AS localizer
       FROM lineitem GROUP BY l_orderkey""",
)
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"), F.min_by("l_shipdate", F.struct("l_linenumber", "l_partkey", "l_shipdate")).alias("first_date"),
        F.min(F.date_format("l_shipdate", "HHmmss")).alias("least_clock"), F.round(F.max("l_extendedprice") - F.min("l_extendedprice"), 2).alias("spread"), (F.count(F.lit(1)) < 3).alias("localizer"),
    )


@CATALOG.add(
    "mode_orientation",
    """WITH c AS (SELECT l_orderkey, round_even(l_discount, 1) AS v, count(*) AS n, min(l_linenumber) AS p FROM lineitem GROUP BY ALL)
       SELECT l_orderkey, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, p, v) AS r FROM c) WHERE r = 1""",
)
def mode_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mode(lines(spark, sf_dir), "l_orderkey", F.bround("l_discount", 1), "l_linenumber")


@CATALOG.add("first_seen_dedup", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).select("l_partkey", "l_orderkey", "l_linenumber")
    return S.first_seen(d, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


@CATALOG.add(
    "acq_rank",
    """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS INTEGER) AS acq,
       CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS of FROM lineitem""",
)
def acq_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.row_number().over(w.orderBy("l_shipdate", "l_linenumber")).alias("acq"), F.count(F.lit(1)).over(w).cast("int").alias("of"))


HINTS = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{label}' END" for p, label in X.PHASE_HINTS)


@CATALOG.add("phase_tags", f"SELECT p_partkey, array_to_string(list_filter([{HINTS}], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT p_partkey, lower(p_name || CASE p_partkey % 5 WHEN 0 THEN ' Fase Arterial y portal' WHEN 1 THEN ' sin c' WHEN 2 THEN ' tardia post' WHEN 3 THEN ' pv' ELSE '' END) AS t FROM part)")
def phase_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    shown = F.concat("p_name", F.when(k == 0, " Fase Arterial y portal").when(k == 1, " sin c").when(k == 2, " tardía post").when(k == 3, " pv").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.phase_hints(shown), ",").alias("tags"))


@CATALOG.add(
    "weighting_rules",
    """SELECT p_partkey, CASE WHEN regexp_matches(t, 'dwi|diff|\\badc\\b|trace') THEN 'difusión' WHEN regexp_matches(t, 'flair') THEN 'FLAIR' WHEN regexp_matches(t, 'stir') THEN 'STIR'
       WHEN regexp_matches(t, 'mrcp|colangio') THEN 'T2 intensa (colangio)' WHEN regexp_matches(t, 'vibe|lava|thrive|\\bt1\\b|t1w|t1_') THEN 'T1' WHEN regexp_matches(t, 'haste|ssfse|\\bt2\\b|t2w|t2_') THEN 'T2'
       WHEN ti > 1500 THEN 'FLAIR' WHEN ti BETWEEN 100 AND 250 THEN 'STIR' WHEN tr <> 0 AND te <> 0 AND tr < 1000 AND te < 30 THEN 'T1'
       WHEN tr >= 1500 AND te >= 60 THEN 'T2' WHEN te <> 0 AND tr >= 1500 AND te < 40 THEN 'densidad protónica' ELSE '?' END AS kind
       FROM (SELECT p_partkey, lower(p_type) AS t, p_size * 2.0 AS te, p_retailprice AS tr, CASE WHEN p_partkey % 7 = 0 THEN p_size * 40.0 ELSE 0 END AS ti FROM part)""",
)
def weighting_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ti = F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") * 40.0)
    kind = S.weighting(X.fold(F.col("p_type")), F.lit(""), F.lit(None).cast("double"), F.col("p_size") * 2.0, F.col("p_retailprice"), ti)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@CATALOG.add(
    "clock_parse",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN h || ':' || m || ':' || s WHEN 1 THEN h || ':00:00' WHEN 2 THEN h || ':' || m || ':00' ELSE '' END AS clock,
       CASE o_orderkey % 4 WHEN 0 THEN CAST(h AS INTEGER) * 3600 + CAST(m AS INTEGER) * 60 + CAST(s AS INTEGER) WHEN 1 THEN CAST(h AS INTEGER) * 3600 WHEN 2 THEN CAST(h AS INTEGER) * 3600 + CAST(m AS INTEGER) * 60 END AS seconds
       FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') AS h, lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS m, lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS s FROM orders)""",
)
def clock_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s = two(F.col("o_orderkey") % 24), two(F.col("o_orderkey") % 60), two(F.col("o_custkey") % 60)
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.concat(h, m, s, F.lit(".5343"))).when(k == 1, h).when(k == 2, F.concat(h, m)).otherwise("x")
    clock, seconds = X.clock(shown)
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.alias("clock"), seconds.cast("int").alias("seconds"))


@CATALOG.add(
    "series_suggest",
    """SELECT p_partkey, CAST(row_number() OVER (ORDER BY o, c, b, coverage DESC, p_partkey) AS INTEGER) AS rank FROM (
       SELECT p_partkey, p_size, CASE WHEN p_type LIKE '%A%' THEN 0 ELSE 1 END AS o, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS c, round_even(p_size / 10.0 / 0.25, 0) AS b, p_retailprice AS coverage
       FROM part WHERE p_size >= 20) ORDER BY o, c, b, coverage DESC, p_partkey LIMIT 3""",
)
def series_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.operators.ranking import top

    order = S.suggest_order(F.contains("p_type", F.lit("A")), F.col("p_partkey") % 3 == 0, F.col("p_size") / 10.0, F.col("p_retailprice"), F.col("p_partkey"))
    return top(table(spark, sf_dir, "part").where("p_size >= 20"), order, 3).select("p_partkey", "rank")


@CATALOG.add(
    "series_order",
    """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(num, 1000000000), o_orderkey) AS INTEGER) AS idx
       FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS num FROM orders)""",
)
def series_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = F.when(F.col("o_orderkey") % 5 != 0, F.substring("o_orderpriority", 1, 1).try_cast("int"))
    w = Window.partitionBy("o_custkey").orderBy(F.coalesce(num, F.lit(10**9)), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("idx"))


@CATALOG.add(
    "stack_split",
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus,
         CASE WHEN l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) <= 0.001 THEN 1 ELSE 0 END AS d,
         CASE WHEN l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity) <= 0.001 THEN 1 ELSE 0 END AS d1,
         CASE WHEN l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_quantity) <= 0.001 THEN 1 ELSE 0 END AS d2,
         count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n1, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS f1,
         count(*) OVER (PARTITION BY l_orderkey, l_linestatus) AS n2, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_linestatus) AS f2,
         count(*) OVER (PARTITION BY l_orderkey) AS c, row_number() OVER (PARTITION BY l_orderkey, l_quantity ORDER BY l_linenumber) AS one FROM lineitem),
       x AS (SELECT *, max(d) OVER w AS dup, max(d1) OVER w AS x1, max(d2) OVER w AS x2, min(1000000 - n1 * 1000 + f1) OVER w AS m1, min(1000000 - n2 * 1000 + f2) OVER w AS m2 FROM d WINDOW w AS (PARTITION BY l_orderkey)),
       y AS (SELECT *, CASE WHEN dup = 0 THEN 0 WHEN x1 = 0 AND c > n1 THEN 1 WHEN x2 = 0 AND c > n2 THEN 2 ELSE -1 END AS split FROM x)
       SELECT l_orderkey, l_linenumber, CAST(split AS INTEGER) AS split FROM y
       WHERE split = 0 OR (split = 1 AND 1000000 - n1 * 1000 + f1 = m1) OR (split = 2 AND 1000000 - n2 * 1000 + f2 = m2) OR (split = -1 AND one = 1)""",
)
def stack_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    # eight parts for each of the files' splits, whose size has a limit, so that what a task sorts doesn't grow with the table
    d = d.repartition(8 * d.rdd.getNumPartitions(), "l_orderkey")
    return S.split_stack(d, "l_orderkey", "l_quantity", "l_linenumber", [["l_returnflag"], ["l_linestatus"]]).select("l_orderkey", "l_linenumber", "split")


@CATALOG.add(
    "normal_orientation",
    """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b, embedding[3]::DOUBLE c, embedding[4]::DOUBLE d, embedding[5]::DOUBLE e, embedding[6]::DOUBLE f FROM embeddings),
       n AS (SELECT vec_id, b * f - c * e AS x, c * d - a * f AS y, a * e - b * d AS z FROM v),
       u AS (SELECT vec_id, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM n))
       SELECT vec_id, CASE WHEN greatest(abs(x), abs(y), abs(z)) >= 0.97 THEN k ELSE 'oblicuo(~' || k || ')' END AS orientation
       FROM (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 'sagital' WHEN abs(y) >= abs(z) THEN 'coronal' ELSE 'axial' END AS k FROM u)""",
)
def normal_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.operators.geometry import cross, unit

    v = [F.element_at("embedding", i).cast("double") for i in range(1, 7)]
    n = unit(*cross(v[:3], v[3:]))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(k) for c, k in zip(n, "xyz")]).select("vec_id", S.orientation(F.col("x"), F.col("y"), F.col("z")).alias("orientation"))


@CATALOG.add(
    "contrast_evidence",
    """SELECT p_partkey, CASE WHEN agent <> '' THEN 'agente: ' || agent WHEN hint <> '' THEN 'descripción: ' || hint WHEN protocol <> '' THEN 'protocolo: ' || protocol ELSE 'no consta' END AS evidence
       FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END AS agent, CASE WHEN p_partkey % 3 = 0 THEN 'arterial' ELSE '' END AS hint, CASE WHEN p_partkey % 2 = 0 THEN 'con contraste' ELSE '' END AS protocol FROM part)""",
)
def contrast_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    agent, hint, protocol = F.when(k % 5 == 0, F.col("p_brand")), F.when(k % 3 == 0, "arterial"), F.when(k % 2 == 0, "con contraste")
    found = F.coalesce(F.concat(F.lit("agente: "), agent), F.concat(F.lit("descripción: "), hint), F.concat(F.lit("protocolo: "), protocol), F.lit("no consta"))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("evidence"))


@CATALOG.add(
    "frame_explode",
    "SELECT vec_id, CAST(vec_id * 100000 + i AS BIGINT) AS instance, round(embedding[i + 1]::DOUBLE, 6) AS v FROM embeddings, range(64) t(i)",
)
def frame_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return d.select("vec_id", (F.col("vec_id") * 100000 + F.col("i")).alias("instance"), F.round(F.col("v").cast("double"), 6).alias("v"))


@CATALOG.add(
    "selector_resolution",
    """WITH s AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS num FROM orders)
       SELECT o_custkey, CASE n WHEN 1 THEN by_num WHEN 0 THEN by_idx END AS chosen, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 0 AND by_idx IS NULL THEN 'missing' ELSE 'found' END AS status
       FROM (SELECT o_custkey, count(*) FILTER (num = 2) AS n, min(o_orderkey) FILTER (num = 2) AS by_num, min(o_orderkey) FILTER (idx = 2) AS by_idx FROM s GROUP BY o_custkey)""",
)
def selector_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selector 2 in each customer's series: by number; where no number matches, by index; see resolve()."""
    w = Window.partitionBy("o_custkey")
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w.orderBy("o_orderkey")).alias("idx"), F.substring("o_orderpriority", 1, 1).cast("int").alias("num"))
    return S.resolve(s, "o_custkey", "o_orderkey", "num", "idx", 2)
