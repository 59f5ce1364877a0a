"""Smaller rules of reports, viewers, searches and measures. Every SQL text has its constants written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import clinical as C
from heddle.functions import text as X
from heddle.functions.geo import haversine
from heddle.operators import voxels as V
from heddle.session import Catalog, table

from .search import AT, MILES_SQL, SITES_SQL, sites
from .voxels import M_SQL, SHAPE, label_sql, mask

CATALOG = Catalog()
PATIENT_SQL = "SELECT c_custkey, c_custkey % 100 AS age, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, c_custkey % 3 = 0 AS frail, c_custkey % 90 * 1.0::DOUBLE AS hdl, c_custkey % 100 / 10.0::DOUBLE AS uric, 0.4 + c_custkey % 30 / 10.0::DOUBLE AS creatinine FROM customer"


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k, (k % 100).alias("age"), F.when(k % 2 == 0, "M").otherwise("F").alias("sex"), (k % 3 == 0).alias("frail"),
        (k % 90 * 1.0).alias("hdl"), (k % 100 / 10.0).alias("uric"), (F.lit(0.4) + k % 30 / 10.0).alias("creatinine"),
    )


@CATALOG.add("a1c_goals", f"SELECT c_custkey, CASE WHEN frail AND age >= 65 THEN '<8.5' WHEN age >= 75 THEN '<7.5-8' WHEN age >= 65 THEN '<7-7.5' WHEN age >= 18 THEN '<7' END AS goal FROM ({PATIENT_SQL})")
def a1c_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patients(spark, sf_dir).select("c_custkey", C.a1c_goal(F.col("age"), F.col("frail")).alias("goal"))


@CATALOG.add(
    "sex_classes",
    f"""SELECT c_custkey, CASE WHEN hdl < CASE sex WHEN 'M' THEN 40 ELSE 50 END THEN 'low' WHEN hdl < 60 THEN 'borderline' ELSE 'high' END AS hdl,
        CASE sex WHEN 'M' THEN CASE WHEN uric < 3.4 THEN 'low' WHEN uric > 7.0 THEN 'high' ELSE 'normal' END ELSE CASE WHEN uric < 2.4 THEN 'low' WHEN uric > 6.0 THEN 'high' ELSE 'normal' END END AS uric_acid FROM ({PATIENT_SQL})""",
)
def sex_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patients(spark, sf_dir).select("c_custkey", C.hdl(F.col("hdl"), F.col("sex")).alias("hdl"), C.uric_acid(F.col("uric"), F.col("sex")).alias("uric_acid"))


@CATALOG.add(
    "report_tone",
    f"""SELECT c_custkey, CASE WHEN age >= 75 THEN 'warm' WHEN age >= 65 THEN 'respectful' WHEN age >= 40 THEN 'practical' WHEN age >= 18 THEN 'peer-like' WHEN age >= 12 THEN 'direct' ELSE 'with a parent' END AS tone,
        CASE WHEN age >= 75 THEN 'usted, Don/Doña' WHEN age >= 65 THEN 'usted' WHEN age >= 40 THEN 'tú or usted' WHEN age >= 12 THEN 'first name, tú' ELSE 'first name' END AS address FROM ({PATIENT_SQL})""",
)
def report_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    tone, address = C.tone(F.col("age"))
    return patients(spark, sf_dir).select("c_custkey", tone.alias("tone"), address.alias("address"))


@CATALOG.add(
    "filtration_rate",
    f"""SELECT c_custkey, round(142 * pow(least(creatinine / CASE sex WHEN 'F' THEN 0.7 ELSE 0.9 END, 1), CASE sex WHEN 'F' THEN -0.241 ELSE -0.302 END) * pow(greatest(creatinine / CASE sex WHEN 'F' THEN 0.7 ELSE 0.9 END, 1), -1.2)
        * pow(0.9938, age) * CASE sex WHEN 'F' THEN 1.012 ELSE 1 END, 4) AS egfr FROM ({PATIENT_SQL})""",
)
def filtration_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patients(spark, sf_dir).select("c_custkey", F.round(C.egfr(F.col("creatinine"), F.col("age"), F.col("sex")), 4).alias("egfr"))


@CATALOG.add(
    "site_entries",
    f"""SELECT n_name, CAST(row_number() OVER (PARTITION BY n_name ORDER BY coalesce(m, 0), s_suppkey) AS INTEGER) AS place, s_suppkey, CAST(m AS INTEGER) AS distance_miles, CASE WHEN coalesce(status, '') <> '' THEN status ELSE 'not listed (study is RECRUITING)' END AS status
        FROM (SELECT *, CASE WHEN s_suppkey % 10 <> 0 THEN round_even({MILES_SQL}, 0) END AS m FROM ({SITES_SQL}))""",
)
def site_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study (here a nation) keeps its sites in an array: each becomes an entry of its own names, and the entries are
    sorted by rounded distance (unknown first, as 0), then in their first order."""
    s = sites(spark, sf_dir).withColumn("lat", F.when(F.col("s_suppkey") % 10 != 0, F.col("lat")))
    study = s.groupBy("n_name").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "lat", "lon", "status"))).alias("sites"))

    def entry(site):
        miles = F.bround(haversine(F.lit(AT[0]), F.lit(AT[1]), site.lat, site.lon), 0).cast("int")
        known = F.when(X.clean(site.status) != "", X.clean(site.status)).otherwise("not listed (study is RECRUITING)")
        return F.struct(F.coalesce(miles, F.lit(0)).alias("by"), site.s_suppkey.alias("s_suppkey"), miles.alias("distance_miles"), known.alias("status"))

    entries = study.select("n_name", F.posexplode(F.array_sort(F.transform("sites", entry))).alias("place", "e"))
    return entries.select("n_name", (F.col("place") + 1).alias("place"), "e.s_suppkey", "e.distance_miles", "e.status")


@CATALOG.add(
    "field_variants",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 = 0 THEN 'shared ' || s_name WHEN s_suppkey % 3 <> 0 THEN s_name ELSE 'untitled' END AS title,
       CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'shared ' || s_name ELSE 'copy' END WHEN s_suppkey % 3 <> 0 THEN s_name ELSE '' END AS banner FROM supplier""",
)
def field_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    own, shared, sharing = F.when(k % 3 != 0, F.col("s_name")).otherwise(""), F.when(k % 4 == 0, F.concat(F.lit("shared "), "s_name")), k % 2 == 0
    return table(spark, sf_dir, "supplier").select(k, X.variant(own, shared, sharing, "untitled").alias("title"), X.banner(own, shared, sharing, "copy").alias("banner"))


@CATALOG.add(
    "hue_band",
    """SELECT s_suppkey, round(h, 4) AS hue, h BETWEEN 285 AND 345 AND s >= 0.25 AND v >= 0.25 AS reserved FROM (
         SELECT s_suppkey, v, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s, (CASE WHEN d = 0 THEN 0 WHEN v = r THEN (g - b) / d WHEN v = g THEN 2 + (b - r) / d ELSE 4 + (r - g) / d END * 60 + 360) % 360 AS h FROM (
           SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM (
             SELECT s_suppkey, s_suppkey * 7 % 256 / 255.0::DOUBLE AS r, s_suppkey * 11 % 256 / 255.0::DOUBLE AS g, s_suppkey * 13 % 256 / 255.0::DOUBLE AS b FROM supplier)))""",
)
def hue_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in the band of hues that is reserved (285 to 345 degrees here) and not too grey or dark."""
    k = F.col("s_suppkey")
    h, s, v = X.hue(k * 7 % 256, k * 11 % 256, k * 13 % 256)
    return table(spark, sf_dir, "supplier").select(k, F.round(h, 4).alias("hue"), (h.between(285, 345) & (s >= 0.25) & (v >= 0.25)).alias("reserved"))


@CATALOG.add("unknown_groups", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3)")
def unknown_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures whose group isn't among the groups that are listed."""
    listed = table(spark, sf_dir, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(listed), "s_nationkey", "left_anti").select("s_suppkey", "s_nationkey")


VIEW_SQL = """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '<meta charset="utf-8">' ELSE '' END || '<a class="tab on" data-tab="t' || s_suppkey % 5 || '" href="#panel-t' || s_suppkey % 3 || '">x</a><div id="panel-t' || s_suppkey % 4 || '" class="' || CASE WHEN s_suppkey % 7 = 0 THEN 'box oculto' ELSE 'box' END || '">y</div>' || CASE WHEN s_suppkey % 3 = 0 THEN '<noscript>z</noscript>' ELSE '' END AS html FROM supplier"""


@CATALOG.add(
    "no_script_checks",
    f"""SELECT s_suppkey, regexp_matches(html, 'class="[^"]*\\boculto\\b') AS hidden, len(a) = 0 AS no_tabs, a[1] <> b[1] OR NOT contains(html, 'id="panel-' || b[1] || '"') AS lost_panel, NOT contains(html, '<noscript>') AS no_block, NOT starts_with(html, '<meta charset="utf-8">') AS no_charset
        FROM (SELECT *, regexp_extract_all(html, '<a class="tab[^"]*" data-tab="([^"]+)" href="#panel-([^"]+)"', 1) AS a, regexp_extract_all(html, '<a class="tab[^"]*" data-tab="([^"]+)" href="#panel-([^"]+)"', 2) AS b FROM ({VIEW_SQL}))""",
)
def no_script_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page would lose without scripts: hidden classes, tabs that aren't anchors to their panels, missing blocks."""
    k, text = F.col("s_suppkey"), lambda x: F.lit(x)
    num = lambda n: (k % n).cast("string")
    html = F.concat(
        F.when(k % 2 == 0, '<meta charset="utf-8">').otherwise(""), text('<a class="tab on" data-tab="t'), num(5), text('" href="#panel-t'), num(3), text('">x</a><div id="panel-t'), num(4),
        text('" class="'), F.when(k % 7 == 0, "box oculto").otherwise("box"), text('">y</div>'), F.when(k % 3 == 0, "<noscript>z</noscript>").otherwise(""),
    )
    d = table(spark, sf_dir, "supplier").select(k, html.alias("html"))
    tab = F.lit('<a class="tab[^"]*" data-tab="([^"]+)" href="#panel-([^"]+)"')
    pairs = F.arrays_zip(F.regexp_extract_all("html", tab, 1).alias("a"), F.regexp_extract_all("html", tab, 2).alias("b"))
    lost = F.exists("tabs", lambda t: (t.a != t.b) | ~F.contains("html", F.concat(F.lit('id="panel-'), t.b, F.lit('"'))))
    d = d.withColumn("tabs", pairs)
    return d.select(
        "s_suppkey", F.col("html").rlike(r'class="[^"]*\boculto\b').alias("hidden"), (F.size("tabs") == 0).alias("no_tabs"), lost.alias("lost_panel"),
        (~F.contains("html", F.lit("<noscript>"))).alias("no_block"), (~F.startswith("html", F.lit('<meta charset="utf-8">'))).alias("no_charset"),
    )


@CATALOG.add("sleeve_warnings", "SELECT l_partkey, count(*) FILTER (l_quantity >= 0.9 * 50) AS near, count(*) FILTER (l_quantity >= 0.9 * 50) > 0 AS warn FROM lineitem GROUP BY l_partkey")
def sleeve_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations whose outer radius reaches nine tenths of the sleeve's: the wall may be thicker than was measured."""
    near = F.count_if(F.col("l_quantity") >= 0.9 * 50)
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(near.alias("near")).withColumn("warn", F.col("near") > 0)


@CATALOG.add(
    "criterion",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 10.0 WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN NULL ELSE 150.0 END::DOUBLE AS low, CASE WHEN o_orderkey % 5 = 0 THEN 20.0 WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN -400.0 END::DOUBLE AS high,
       CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 THEN 'a range is needed' END AS error FROM orders""",
)
def criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of values of a lumen: the one given, else the preset of air or contrast, which only CT has."""
    k = F.col("o_orderkey")
    given, ct, air = k % 5 == 0, k % 3 != 0, k % 2 == 0
    low = F.when(given, 10.0).when(ct & ~air, 150.0)
    high = F.when(given, 20.0).when(ct & air, -400.0)
    return table(spark, sf_dir, "orders").select(k, low.alias("low"), high.alias("high"), F.when(~given & ~ct, "a range is needed").alias("error"))


@CATALOG.add(
    "runs_joined",
    "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity < 25, l_linenumber) AS INTEGER) AS place FROM lineitem",
)
def runs_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of runs, one after the other."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    both = d.where("l_quantity >= 25").withColumn("list", F.lit(0)).unionByName(d.where("l_quantity < 25").withColumn("list", F.lit(1)))
    return both.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("list", "l_linenumber")).alias("place"))


@CATALOG.add("grow_fixpoint", f"SELECT vol, k, j, i FROM ({label_sql(M_SQL)}) JOIN (SELECT vol, label FROM ({label_sql(M_SQL)}) WHERE k = 1 AND j = 1 AND i = 1) USING (vol, label)")
def grow_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on the voxel (1, 1, 1) of each volume, grown step by step until nothing is added."""
    m = mask(spark, sf_dir)
    return V.grow_until(m.where("k = 1 and j = 1 and i = 1"), m, SHAPE, 64)


@CATALOG.add("axis_extents", f"SELECT DISTINCT vol, 'k' AS axis, k AS at FROM ({M_SQL}) UNION ALL SELECT DISTINCT vol, 'j', j FROM ({M_SQL}) UNION ALL SELECT DISTINCT vol, 'i', i FROM ({M_SQL})")
def axis_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planes along each axis in which a mask has a voxel."""
    each = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("at")) for c in "kji"])
    return mask(spark, sf_dir).select("vol", F.explode(each).alias("p")).select("vol", "p.axis", "p.at").distinct()


@CATALOG.add("error_totals", "SELECT user_id, CAST(sum(event_id % 3) AS BIGINT) AS errors, count(*) FILTER (event_id % 3 > 0) AS captures FROM events GROUP BY user_id")
def error_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors (a list for each capture) in all, and captures that have any."""
    errors = F.array_repeat(F.lit("e"), (F.col("event_id") % 3).cast("int"))
    d = table(spark, sf_dir, "events").select("user_id", errors.alias("errors"))
    return d.groupBy("user_id").agg(F.sum(F.size("errors")).alias("errors"), F.count_if(F.size("errors") > 0).alias("captures"))


@CATALOG.add(
    "node_catalogue",
    """SELECT p_brand AS node, (min(p_size) + max(p_size)) / 2.0::DOUBLE AS centre_x, max(p_size) - min(p_size) AS size_x, round((min(p_retailprice) + max(p_retailprice)) / 2, 6) AS centre_y, round(max(p_retailprice) - min(p_retailprice), 6) AS size_y FROM part GROUP BY p_brand
       UNION ALL SELECT 'all', (min(p_size) + max(p_size)) / 2.0::DOUBLE, max(p_size) - min(p_size), round((min(p_retailprice) + max(p_retailprice)) / 2, 6), round(max(p_retailprice) - min(p_retailprice), 6) FROM part""",
)
def node_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and size of each node's box, and of the box of all."""
    x, y = F.col("p_size"), F.col("p_retailprice")
    box = [((F.min(x) + F.max(x)) / 2.0).alias("centre_x"), (F.max(x) - F.min(x)).alias("size_x"), F.round((F.min(y) + F.max(y)) / 2, 6).alias("centre_y"), F.round(F.max(y) - F.min(y), 6).alias("size_y")]
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("node")).agg(*box).unionByName(p.agg(*box).withColumn("node", F.lit("all")))


@CATALOG.add(
    "far_points",
    """SELECT s_suppkey FROM supplier WHERE s_acctbal / 100 < 0 - greatest(2, 0.3 * 60) OR s_acctbal / 100 > 60 + greatest(2, 0.3 * 60) OR s_suppkey % 50 > 30 + greatest(2, 0.3 * 30) OR s_nationkey > 4 + greatest(2, 0.3 * 4)""",
)
def far_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points beyond a model's box by over 30 % of its side, and over 2."""
    far = F.lit(False)
    for c, low, high in ((F.col("s_acctbal") / 100, 0, 60), (F.col("s_suppkey") % 50, 0, 30), (F.col("s_nationkey"), 0, 4)):
        margin = max(2.0, 0.3 * (high - low))
        far = far | (c < low - margin) | (c > high + margin)
    return table(spark, sf_dir, "supplier").where(far).select("s_suppkey")


@CATALOG.add("profile_list", "SELECT s_suppkey, CAST(n AS INTEGER) AS place, folder, name FROM (SELECT s_suppkey, unnest(['Default', 'Profile 1', 'Profile 2']) AS folder, unnest([s_name, 'p' || s_suppkey, 'q']) AS name, unnest([1, 2, 3]) AS n FROM supplier)")
def profile_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a JSON object of profiles, sorted by folder."""
    k = F.col("s_suppkey")
    info = F.to_json(F.map_from_arrays(F.array(F.lit("Profile 2"), F.lit("Default"), F.lit("Profile 1")), F.array(F.struct(F.lit("q").alias("name")), F.struct(F.col("s_name").alias("name")), F.struct(F.concat(F.lit("p"), k.cast("string")).alias("name")))))
    d = table(spark, sf_dir, "supplier").select(k, F.from_json(info, "map<string, struct<name: string>>").alias("m"))
    d = d.select(k, F.posexplode(F.array_sort(F.map_entries("m"))).alias("place", "e"))
    return d.select(k, (F.col("place") + 1).alias("place"), F.col("e.key").alias("folder"), F.col("e.value.name").alias("name"))


@CATALOG.add("wrapped_text")
def wrapped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form: a fold over words. Tested against the standard library."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.wrapped("text", 60)).alias("line", "text"))
    return t.select("item_id", (F.col("line") + 1).alias("line"), "text")
