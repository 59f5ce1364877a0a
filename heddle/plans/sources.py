"""Queries of scans, nested projection and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.session import Catalog, table

CATALOG = Catalog()


@CATALOG.add("scan_project", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount > 0.05")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_discount") > 0.05)).select("l_orderkey", "l_quantity")


STUDY = T.StructType().add("protocol", T.StructType().add("id", T.StructType().add("nct", T.StringType())).add("phases", T.ArrayType(T.StringType())).add("sites", T.ArrayType(T.StructType().add("city", T.StringType()).add("status", T.StringType()))))


@CATALOG.add(
    "nested_defaults",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS nct, CASE WHEN s_suppkey % 2 = 0 THEN 'PHASE2,PHASE1' ELSE '' END AS phases, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS open_sites FROM supplier""",
)
def nested_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON whose keys may be missing at every level, read by schema, with empty defaults."""
    k = F.col("s_suppkey")
    nct = F.when(k % 3 != 0, F.col("s_name"))
    phases = F.when(k % 2 == 0, F.array(F.lit("PHASE2"), F.lit("PHASE1")))
    sites = F.array(F.struct(F.lit("a").alias("city"), F.lit("COMPLETED").alias("status")), F.struct(F.lit("b").alias("city"), F.when(k % 5 == 0, "COMPLETED").otherwise("RECRUITING").alias("status")))
    raw = F.to_json(F.struct(F.struct(F.struct(nct.alias("nct")).alias("id"), phases.alias("phases"), sites.alias("sites")).alias("protocol")))
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.from_json(raw, STUDY).alias("s"))
    open_ = F.size(F.filter("s.protocol.sites", lambda x: x["status"] == "RECRUITING"))
    return d.select("s_suppkey", F.coalesce("s.protocol.id.nct", F.lit("")).alias("nct"), F.coalesce(F.array_join("s.protocol.phases", ","), F.lit("")).alias("phases"), open_.alias("open_sites"))


@CATALOG.add("attribute_fallback", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size WHEN p_partkey % 2 = 0 THEN 7 ELSE 1 END AS v FROM part")
def attribute_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own value, else the shared, else 1: zero and empty fall through as missing does."""
    true = lambda c: F.nullif(c, F.lit(0))
    own, shared = F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0), F.when(F.col("p_partkey") % 2 == 0, 7).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(true(own), true(shared), F.lit(1)).alias("v"))


@CATALOG.add("privacy_projection", "SELECT c_custkey % 10 AS bucket, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def privacy_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allow-list: names and balances never leave."""
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("bucket"), "c_mktsegment").groupBy("bucket", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.add("merge_precedence", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 2 = 0 THEN p_type END, 'default') AS v FROM part")
def merge_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.when(k % 3 == 0, F.col("p_brand")), F.when(k % 2 == 0, F.col("p_type")), F.lit("default")).alias("v"))


@CATALOG.add("page_union", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0")
def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.where("o_orderkey % 3 = 0").unionByName(o.where("o_orderkey % 3 <> 0 or o_orderkey % 5 = 0"))


@CATALOG.add("key_sets", "SELECT DISTINCT p_type AS v, 'both' AS side FROM part WHERE p_size <= 2 AND p_type IN (SELECT p_type FROM part WHERE p_size > 2) UNION ALL SELECT DISTINCT p_type, 'first' FROM part WHERE p_size <= 2 AND p_type NOT IN (SELECT p_type FROM part WHERE p_size > 2)")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b = p.where("p_size <= 2").select(F.col("p_type").alias("v")), p.where("p_size > 2").select(F.col("p_type").alias("v"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


@CATALOG.add(
    "clock12",
    """SELECT o_orderkey, CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || CASE WHEN h < 12 THEN ' a.m.' ELSE ' p.m.' END AS clock,
       ['dom','lun','mar','mié','jue','vie','sáb'][dayofweek(o_orderdate) + 1] || ' ' || day(o_orderdate) || ' ' || ['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic'][month(o_orderdate)] AS label FROM (SELECT *, o_orderkey % 24 AS h FROM orders)""",
)
def clock12(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("o_orderkey") % 24
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12)
    clock = F.concat(twelve.cast("string"), F.lit(":"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"), F.when(h < 12, " a.m.").otherwise(" p.m."))
    days, months = (F.array(*map(F.lit, n.split())) for n in ("dom lun mar mié jue vie sáb", "ene feb mar abr may jun jul ago sep oct nov dic"))
    label = F.concat_ws(" ", F.element_at(days, F.dayofweek("o_orderdate")), F.dayofmonth("o_orderdate").cast("string"), F.element_at(months, F.month("o_orderdate")))
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.alias("clock"), label.alias("label"))


@CATALOG.add("palette_fallback", "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'red' WHEN 'Brand#22' THEN 'blue' ELSE ['a', 'b', 'c'][n % 3 + 1] END AS colour FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)")
def palette_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named colour, else one of the palette by place."""
    from pyspark.sql import Window

    named = F.create_map(*[F.lit(x) for x in ("Brand#11", "red", "Brand#22", "blue")])
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", n.alias("n"))
    return p.select("p_partkey", F.coalesce(F.try_element_at(named, F.col("p_brand")), F.element_at(F.array(*map(F.lit, "abc")), (F.col("n") % 3 + 1).cast("int"))).alias("colour"))


@CATALOG.add("unknown_keys", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'extra' ELSE '' END AS unknown FROM events")
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys outside the list; those that begin with '_' are comments."""
    keys = F.map_keys(F.from_json(F.when(F.col("event_id") % 3 == 0, '{"k": "1", "extra": "2", "_note": "3"}').otherwise('{"k": "1", "_note": "3"}'), "map<string,string>"))
    odd = F.array_except(F.filter(keys, lambda k: ~k.startswith("_")), F.array(F.lit("k")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(odd), ",").alias("unknown"))


@CATALOG.add("agenda_split", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'coming' ELSE 'past' END ELSE 'errand' END AS kind FROM orders")
def agenda_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appointments to come and past, compared as ISO text; anything that isn't an appointment, or has no kind, is an errand."""
    day = F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(""))
    kind = F.when(F.col("o_orderpriority").startswith("1"), F.when((day != "") & (day >= "1998-01-01"), "coming").otherwise("past")).otherwise("errand")
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))


@CATALOG.add("style_defaults", "SELECT p_name AS k, arg_min(CASE WHEN p_size % 2 = 0 THEN p_size / 50.0::DOUBLE ELSE 1.0 END, p_partkey) AS alpha, min(p_partkey) AS first FROM part WHERE p_partkey % 10 <> 0 GROUP BY p_name")
def style_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults fill gaps, the first of repeated keys wins, rows without a key are dropped."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("k"), F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 50.0), F.lit(1.0)).alias("a"), "p_partkey")
    return p.where("k is not null").groupBy("k").agg(F.min_by("a", "p_partkey").alias("alpha"), F.min("p_partkey").alias("first"))


@CATALOG.add("seed_to_grid", "SELECT p_partkey, CAST(round_even((p_size - 4 - 0.5) / 2, 0) AS INTEGER) AS k, round_even((p_size - 4 - 0.5) / 2, 0) BETWEEN 0 AND 19 AS inside FROM part")
def seed_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.operators.geometry import to_reduced

    k = F.rint(to_reduced(F.col("p_size"), 4, 2))
    return table(spark, sf_dir, "part").select("p_partkey", k.cast("int").alias("k"), k.between(0, 19).alias("inside"))


@CATALOG.add("point_spellings", "SELECT event_id, round(value / CASE WHEN event_id % 2 = 0 THEN 10 ELSE 1 END, 6) AS cm FROM events")
def point_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same measure under several keys and units."""
    raw = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("value").alias("radio_mm")))).otherwise(F.to_json(F.struct(F.col("value").alias("radio"))))
    p = F.from_json(raw, "radio double, radio_mm double, radius double")
    return table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", F.round(F.coalesce("p.radio", "p.radius", F.col("p.radio_mm") / 10), 6).alias("cm"))
