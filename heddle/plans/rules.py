"""Queries of validation rules, comparisons and archive checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators import rules as R
from heddle.session import Catalog, table

CATALOG = Catalog()
ITEM_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'k ' || p_partkey ELSE 'k' || p_partkey % 1900 END AS k, CASE WHEN p_partkey % 40 = 0 THEN ' ' ELSE p_name END AS n,
  p_size / 45.0::DOUBLE AS a, CASE WHEN p_partkey % 60 = 0 THEN '#12' ELSE '#12ab9f' END AS c, CASE WHEN p_partkey % 9 = 0 THEN 'k' || p_partkey * 3 % 4000 END AS con FROM part"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 50 == 0, F.concat(F.lit("k "), s(k))).otherwise(F.concat(F.lit("k"), s(k % 1900))).alias("k"), F.when(k % 40 == 0, " ").otherwise(F.col("p_name")).alias("n"),
        (F.col("p_size") / 45.0).alias("a"), F.when(k % 60 == 0, "#12").otherwise("#12ab9f").alias("c"), F.when(k % 9 == 0, F.concat(F.lit("k"), s(k * 3 % 4000))).alias("con"),
    )


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value rules in one pass, repeated keys by a sum, dangling links by an anti join."""
    d = items(spark, sf_dir)
    path = F.concat(F.lit("items["), F.col("p_partkey").cast("string"), F.lit("]"))
    values = R.violations(d, path, [
        ("key", "error", ~F.col("k").rlike("^[A-Za-z0-9_-]+$")), ("name", "error", F.trim("n") == ""), ("alpha", "error", ~F.col("a").between(0, 1)), ("colour", "error", ~F.col("c").rlike("^#[0-9a-fA-F]{6}$")), ("long", "warning", F.length("n") > 12),
    ])
    repeated = R.duplicates(d, ["k"]).select(F.concat(F.lit("key "), F.col("k")).alias("path"), F.lit("error").alias("severity"), F.lit("repeated").alias("rule"))
    loose = R.dangling(d, "con", d, "k").select(path.alias("path"), F.lit("error").alias("severity"), F.lit("link").alias("rule"))
    return values.unionByName(repeated).unionByName(loose)


BROKEN_SQL = f"""WITH i AS ({ITEM_SQL}), p AS (SELECT *, 'items[' || p_partkey || ']' AS path FROM i)
  SELECT path, 'error' AS severity, 'key' AS rule FROM p WHERE NOT regexp_matches(k, '^[A-Za-z0-9_-]+$') UNION ALL SELECT path, 'error', 'name' FROM p WHERE trim(n) = '' UNION ALL SELECT path, 'error', 'alpha' FROM p WHERE NOT a BETWEEN 0 AND 1
  UNION ALL SELECT path, 'error', 'colour' FROM p WHERE NOT regexp_matches(c, '^#[0-9a-fA-F]{{6}}$') UNION ALL SELECT path, 'warning', 'long' FROM p WHERE length(n) > 12
  UNION ALL SELECT 'key ' || k, 'error', 'repeated' FROM i GROUP BY k HAVING count(*) > 1 UNION ALL SELECT path, 'error', 'link' FROM p WHERE con IS NOT NULL AND con NOT IN (SELECT k FROM i)"""


@CATALOG.add("violations", BROKEN_SQL)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken(spark, sf_dir)


@CATALOG.add("violations_gate", f"SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') > 0 AS blocks FROM ({BROKEN_SQL})")
def violations_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocked(broken(spark, sf_dir))


@CATALOG.add("dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@CATALOG.add("fk_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def fk_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dangling(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders").where("o_totalprice > 400000"), "o_custkey")


@CATALOG.add(
    "export_compare",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN abs(a.x - b.x) > 0.01 THEN 'differs' ELSE 'same' END AS status
       FROM (SELECT p_partkey AS k, p_retailprice AS x FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN (SELECT p_partkey AS k, p_retailprice + CASE WHEN p_partkey % 11 = 0 THEN 0.5 ELSE 0.001 END AS x FROM part WHERE p_partkey % 5 <> 0) b ON a.k = b.k""",
)
def export_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x"))
    b = p.where("k % 5 <> 0").withColumn("x", F.col("x") + F.when(F.col("k") % 11 == 0, 0.5).otherwise(0.001))
    return R.compare(p.where("k % 7 <> 0"), b, ["k"], ["x"], 0.01)


@CATALOG.add(
    "near_colours",
    """WITH c AS (SELECT s_suppkey AS id, s_suppkey * 7 % 256 AS r, s_suppkey * 11 % 256 AS g, s_suppkey * 13 % 256 AS b FROM supplier)
       SELECT x.id AS a, y.id AS b, round(sqrt((x.r - y.r) * (x.r - y.r) + (x.g - y.g) * (x.g - y.g) + (x.b - y.b) * (x.b - y.b)), 6) AS distance FROM c x, c y WHERE x.id < y.id AND sqrt((x.r - y.r) * (x.r - y.r) + (x.g - y.g) * (x.g - y.g) + (x.b - y.b) * (x.b - y.b)) < 40""",
)
def near_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select("s_suppkey", (k * 7 % 256).alias("r"), (k * 11 % 256).alias("g"), (k * 13 % 256).alias("b"))
    return R.near_colours(c, "s_suppkey", "r", "g", "b", 40).withColumn("distance", F.round("distance", 6))


@CATALOG.add(
    "box_contains",
    """SELECT b.box, count(p.s_suppkey) AS n FROM (SELECT n_nationkey AS box, n_nationkey * 300.0 - 1000 AS lx, n_nationkey * 300.0 + 900 AS hx, n_nationkey % 5 AS ly, n_nationkey % 5 + 12 AS hy FROM nation) b
       LEFT JOIN supplier p ON s_acctbal BETWEEN lx AND hx AND s_nationkey BETWEEN ly AND hy GROUP BY b.box""",
)
def box_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    boxes = table(spark, sf_dir, "nation").select(k.alias("box"), (k * 300.0 - 1000).alias("low_x"), (k * 300.0 + 900).alias("high_x"), (k % 5).alias("low_y"), (k % 5 + 12).alias("high_y"))
    return R.contained(boxes, table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y")), "xy", 500.0)


@CATALOG.add("index_drift", "SELECT doc_id AS id, 'not indexed' AS drift FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT item_id, 'no file' FROM benchmark WHERE item_id * 100 NOT IN (SELECT doc_id FROM documents)")
def index_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab, b = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    loose = b.select((F.col("item_id") * 100).alias("doc_id"), "item_id").join(d.select("doc_id"), "doc_id", "left_anti")
    return d.select("doc_id").join(lab.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.lit("not indexed").alias("drift")).unionByName(loose.select(F.col("item_id").alias("id"), F.lit("no file").alias("drift")))


@CATALOG.add(
    "annex_pages",
    """SELECT o_orderkey, CASE WHEN c IS NULL THEN 'no citation' WHEN a IS NULL THEN 'no annex' WHEN a <> c THEN 'not one to one' ELSE 'ok' END AS status FROM (
       SELECT coalesce(x.o_orderkey, y.o_orderkey) AS o_orderkey, x.a, y.c FROM (SELECT o_orderkey, 1 AS a FROM orders WHERE o_orderkey % 10 <> 1) x FULL JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS c FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) y ON x.o_orderkey = y.o_orderkey)""",
)
def annex_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 1").select("o_orderkey", F.lit(1).alias("a"))
    c = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("c"))
    status = F.when(F.col("c").isNull(), "no citation").when(F.col("a").isNull(), "no annex").when(F.col("a") != F.col("c"), "not one to one").otherwise("ok")
    return a.join(c, "o_orderkey", "full_outer").select("o_orderkey", status.alias("status"))


@CATALOG.add("blocked_chain", "SELECT a.o_orderkey, a.o_orderstatus, b.o_orderkey AS blocked_by, b.o_orderstatus AS blocker_status FROM orders a LEFT JOIN orders b ON b.o_orderkey = CASE WHEN a.o_orderstatus = 'P' THEN a.o_orderkey // 2 END")
def blocked_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "P", F.floor(F.col("o_orderkey") / 2)).alias("wait"))
    b = o.select(F.col("o_orderkey").alias("blocked_by"), F.col("o_orderstatus").alias("blocker_status"))
    # those that wait for none stay out of the join, where all of them would have one key
    waiting, free = a.where("wait is not null"), a.where("wait is null").select("o_orderkey", "o_orderstatus", *[F.lit(None).cast(t).alias(c) for c, t in b.dtypes])
    return waiting.join(b, waiting["wait"] == b["blocked_by"], "left").drop("wait").unionByName(free)


@CATALOG.add(
    "file_names",
    r"""SELECT doc_id, name, regexp_matches(name, '^\d{4}-\d{2}-\d{2} .+\.[a-z]+$') AS good, regexp_extract(name, '^(\d{4}-\d{2}-\d{2})', 1) AS day FROM (
        SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' ' || source || '.pdf' WHEN 1 THEN source || '.pdf' ELSE '2024-1-5 ' || source || '.pdf' END AS name FROM documents)""",
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    name = F.when(k % 3 == 0, F.concat(F.lit("2024-01-"), day, F.lit(" "), "source", F.lit(".pdf"))).when(k % 3 == 1, F.concat("source", F.lit(".pdf"))).otherwise(F.concat(F.lit("2024-1-5 "), "source", F.lit(".pdf")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).select("doc_id", "name", F.col("name").rlike(r"^\d{4}-\d{2}-\d{2} .+\.[a-z]+$").alias("good"), F.regexp_extract("name", r"^(\d{4}-\d{2}-\d{2})", 1).alias("day"))


@CATALOG.add("sync_clash", "SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey DESC) AS r, count(*) OVER (PARTITION BY p_name) AS c FROM part) WHERE r = 1 AND c > 1")
def sync_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files with the same name the newest is kept; only names that clash are listed."""
    g = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("c"), F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"))
    return g.where("c > 1").select("p_name", "p_partkey")


@CATALOG.add("expected_folders", "SELECT n_name, f AS folder FROM nation, (VALUES ('01'), ('02'), ('03'), ('04'), ('05'), ('06')) x(f) WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND '0' || (s_suppkey % 6 + 1) = f)")
def expected_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(F.array(*[F.lit(f"0{i}") for i in range(1, 7)])).alias("folder"))
    have = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit("0"), (F.col("s_suppkey") % 6 + 1).cast("string")).alias("folder"))
    return want.join(have, ["n_nationkey", "folder"], "left_anti").select("n_name", "folder")


@CATALOG.add("agenda_checks", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open_items, count(*) FILTER (o_orderstatus = 'O') > 8 AS too_many, bool_or(o_custkey % 3 = 0) AS unknown_owner FROM orders GROUP BY o_custkey")
def agenda_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.count_if(F.col("o_orderstatus") == "O")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(open_.alias("open_items"), (open_ > 8).alias("too_many"), F.bool_or(F.col("o_custkey") % 3 == 0).alias("unknown_owner"))


@CATALOG.add("stable_ids", "SELECT s_suppkey FROM supplier EXCEPT SELECT n_nationkey FROM nation")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(old, "s_suppkey", "left_anti")


@CATALOG.add("route_rules", "SELECT user_id, count(*) FILTER (d < 1) AS repeats, count(*) < 2 AS short FROM (SELECT user_id, sqrt(pow(value - lag(value) OVER w, 2)) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id")
def route_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf_dir, "events").select("user_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("d"))
    return d.groupBy("user_id").agg(F.count_if(F.col("d") < 1).alias("repeats"), (F.count(F.lit(1)) < 2).alias("short"))


@CATALOG.add("forbidden_phrases", "SELECT doc_id, regexp_matches(lower(text), 'all rights reserved|licensed') AS forbidden, length(text) > 5000 AS long FROM documents")
def forbidden_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").rlike("all rights reserved|licensed").alias("forbidden"), (F.length("text") > 5000).alias("long"))
