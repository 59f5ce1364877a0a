"""Queries of laboratory rules and purchase tables. Events stand for observations: user is the patient, type the analyte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import clinical as C
from heddle.session import Catalog, table

CATALOG = Catalog()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")


def _case(c: str, t: list) -> str:
    return "CASE WHEN " + c + " IS NULL THEN NULL " + " ".join(f"WHEN {c} >= {low} THEN '{n}'" for low, n in reversed(t) if low != float("-inf")) + f" ELSE '{t[0][1]}' END"


@CATALOG.add("ckd_stage", f"SELECT event_id, {_case('value', C.KIDNEY)} AS stage, CASE WHEN value * 4 < 30 THEN 'A1' WHEN value * 4 <= 300 THEN 'A2' ELSE 'A3' END AS albumin FROM events")
def ckd_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", C.bucket(F.col("value"), C.KIDNEY).alias("stage"), C.albuminuria(F.col("value") * 4).alias("albumin"))


@CATALOG.add(
    "lab_classes",
    f"""SELECT event_id, {_case('value', C.GLUCOSE)} AS glucose, {_case('(value / 10)', C.A1C)} AS a1c, {_case('value', C.LDL)} AS ldl, {_case('value', C.TRIGLYCERIDES)} AS triglycerides, {_case('value', C.CHOLESTEROL)} AS cholesterol,
        CASE WHEN value / 10 > 300 THEN 'marked' ELSE {_case('(value / 10)', C.TRANSAMINASE)} END AS alt, {_case('value', C.VITAMIN_D)} AS vitamin_d, CASE WHEN value > 300 THEN 'normal' ELSE {_case('value', C.B12)} END AS b12 FROM events""",
)
def lab_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return events(spark, sf_dir).select(
        "event_id", C.bucket(v, C.GLUCOSE).alias("glucose"), C.bucket(v / 10, C.A1C).alias("a1c"), C.bucket(v, C.LDL).alias("ldl"), C.bucket(v, C.TRIGLYCERIDES).alias("triglycerides"), C.bucket(v, C.CHOLESTEROL).alias("cholesterol"),
        C.above(v / 10, C.TRANSAMINASE, 300, "marked").alias("alt"), C.bucket(v, C.VITAMIN_D).alias("vitamin_d"), C.above(v, C.B12, 300, "normal").alias("b12"),
    )


@CATALOG.add(
    "haematology",
    f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_case('(value / 10)', C.ANAEMIA['M'])} ELSE {_case('(value / 10)', C.ANAEMIA['F'])} END AS anaemia, CASE WHEN value < 80 THEN 'microcytic' WHEN value <= 100 THEN 'normocytic' ELSE 'macrocytic' END AS mcv,
        CASE WHEN value / 10 < 4 THEN 'leukopenia' WHEN value / 10 < 4.5 THEN 'unclassified' WHEN value / 10 <= 11 THEN 'normal' ELSE 'leukocytosis' END AS leukocytes, {_case('value', C.PLATELETS)} AS platelets FROM events""",
)
def haematology(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, sex = F.col("value"), F.when(F.col("event_id") % 2 == 0, "M").otherwise("F")
    return events(spark, sf_dir).select("event_id", C.anaemia(v / 10, sex).alias("anaemia"), C.mcv(v).alias("mcv"), C.leukocytes(v / 10).alias("leukocytes"), C.bucket(v, C.PLATELETS).alias("platelets"))


@CATALOG.add(
    "age_limits",
    f"""SELECT c_custkey, {_case('age', C.AGES)} AS bracket, CASE WHEN age < 40 THEN NULL WHEN age >= 70 THEN 6.5 WHEN age >= 60 THEN 4.5 WHEN age >= 50 THEN 3.5 ELSE 2.5 END::DOUBLE AS psa, CASE WHEN c_custkey % 2 = 0 THEN age / 2.0 ELSE (age + 10) / 2.0 END AS esr,
        CASE WHEN t < 0.4 THEN 'suppressed' WHEN t <= CASE WHEN age > 70 THEN 6.0 ELSE 4.0 END THEN 'normal' ELSE 'elevated' END AS tsh FROM (SELECT c_custkey, c_custkey % 100 AS age, c_custkey % 80 / 10.0::DOUBLE AS t FROM customer)""",
)
def age_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    age, sex = F.col("c_custkey") % 100, F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F")
    return table(spark, sf_dir, "customer").select("c_custkey", C.bucket(age, C.AGES).alias("bracket"), C.psa_limit(age).alias("psa"), C.esr_limit(age, sex).alias("esr"), C.tsh((F.col("c_custkey") % 80) / 10.0, age).alias("tsh"))


@CATALOG.add(
    "lab_flags",
    """SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN value >= 60 THEN 'high' ELSE 'normal' END WHEN 'view' THEN CASE WHEN value <= 40 THEN 'low' ELSE 'normal' END
       ELSE CASE WHEN value > 100.5 THEN 'high' WHEN value < 20 THEN 'low' ELSE 'normal' END END AS flag FROM events""",
)
def lab_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.when(F.col("event_type") == "click", "< 60").when(F.col("event_type") == "view", "> 40").otherwise("20 - 100.5")
    return events(spark, sf_dir).select("event_id", C.flag(F.col("value"), ref).alias("flag"))


TREND = "SELECT user_id, event_type, CAST(ts AS DATE) AS day, max(value) AS v FROM events GROUP BY ALL"


@CATALOG.add("lab_trend", f"SELECT user_id, event_type, day, round(v, 6) AS v, CASE WHEN v > lag(v) OVER w THEN 'up' WHEN v < lag(v) OVER w THEN 'down' WHEN v = lag(v) OVER w THEN 'same' END AS trend FROM ({TREND}) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day)")
def lab_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("day")
    d = events(spark, sf_dir).groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("v"))
    before = F.lag("v").over(w)
    return d.select("user_id", "event_type", "day", F.round("v", 6).alias("v"), F.when(F.col("v") > before, "up").when(F.col("v") < before, "down").when(F.col("v") == before, "same").alias("trend"))


@CATALOG.add("lab_trend_pivot", "SELECT user_id, event_type, " + ", ".join(f"round(max(value) FILTER (day(ts) // 10 = {i}), 6) AS d{i}" for i in range(4)) + " FROM events GROUP BY ALL")
def lab_trend_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).withColumn("p", F.concat(F.lit("d"), F.floor(F.dayofmonth("ts") / 10).cast("string")))
    return d.groupBy("user_id", "event_type").pivot("p", ["d0", "d1", "d2", "d3"]).agg(F.round(F.max("value"), 6))


@CATALOG.add(
    "value_matrix",
    """WITH s AS (SELECT min(p_size) AS a, max(p_size) AS b FROM part), o AS (SELECT p_partkey, p_retailprice, 0.85::DOUBLE * (p_size - a) / (b - a) + 0.15::DOUBLE * (p_partkey % 5) / 4 AS score FROM part, s)
       SELECT p_partkey, round(score, 6) AS score, round(score / p_retailprice * 1000000, 4) AS points_per_million FROM o""",
)
def value_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised size weighs 0.85, after-sales 0.15; the ends of the scale are one row, broadcast."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    ends = p.agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"))
    score = 0.85 * (F.col("p_size") - F.col("a")) / (F.col("b") - F.col("a")) + 0.15 * (F.col("p_partkey") % 5) / 4
    d = p.crossJoin(F.broadcast(ends)).select("p_partkey", "p_retailprice", score.alias("score"))
    return d.select("p_partkey", F.round("score", 6).alias("score"), F.round(F.col("score") / F.col("p_retailprice") * 1000000, 4).alias("points_per_million"))


@CATALOG.add(
    "price_conflict",
    "SELECT l_partkey, l_extendedprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'A') DESC, l_shipdate DESC, l_extendedprice DESC) AS r FROM lineitem WHERE l_linestatus <> 'F' OR l_tax > 0.02) WHERE r = 1",
)
def price_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verified, latest price wins; offers without shipping are left out."""
    d = table(spark, sf_dir, "lineitem").where("l_linestatus <> 'F' or l_tax > 0.02")
    return d.groupBy("l_partkey").agg(F.max_by("l_extendedprice", F.struct(F.col("l_returnflag") == "A", "l_shipdate", "l_extendedprice")).alias("price"))


@CATALOG.add("disqualified", "SELECT p_partkey, p_size < 8 AS small, p_type LIKE '%STEEL%' AS bad_kind, round(p_size * 0.5::DOUBLE, 2) AS range_low, round(p_size * 0.6::DOUBLE, 2) AS range_high FROM part")
def disqualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") < 8).alias("small"), F.contains("p_type", F.lit("STEEL")).alias("bad_kind"), F.round(F.col("p_size") * 0.5, 2).alias("range_low"), F.round(F.col("p_size") * 0.6, 2).alias("range_high"))


@CATALOG.add("derived_values", "SELECT c_custkey, round(w / (h * h), 6) AS bmi, round(28.7 * a - 46.7, 6) AS mean_glucose FROM (SELECT c_custkey, 50 + c_custkey % 60 AS w, 1.5 + c_custkey % 50 / 100.0::DOUBLE AS h, 5 + c_custkey % 40 / 10.0::DOUBLE AS a FROM customer)")
def derived_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published formulas; approximate."""
    k = F.col("c_custkey")
    w, h, a = 50 + k % 60, 1.5 + (k % 50) / 100.0, 5 + (k % 40) / 10.0
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(w / (h * h), 6).alias("bmi"), F.round(28.7 * a - 46.7, 6).alias("mean_glucose"))


@CATALOG.add("tissue_ranges", "SELECT event_id, CASE WHEN value * 4 - 200 < -400 THEN 'air' WHEN value * 4 - 200 < -30 THEN 'fat' WHEN value * 4 - 200 < 20 THEN 'fluid' WHEN value * 4 - 200 < 150 THEN 'soft tissue' ELSE 'contrast or bone' END AS tissue FROM events")
def tissue_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [(float("-inf"), "air"), (-400, "fat"), (-30, "fluid"), (20, "soft tissue"), (150, "contrast or bone")]
    return events(spark, sf_dir).select("event_id", C.bucket(F.col("value") * 4 - 200, names).alias("tissue"))
