"""Queries of keyed state, cursors, agendas and calendars. Orders stand for agenda items, events for channel messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.text import duration, relative_day
from heddle.operators import state as S
from heddle.operators.ranking import top
from heddle.session import Catalog, table

CATALOG = Catalog()
NOW = "2024-01-20 00:00:00"
CURSOR_SQL = "SELECT * FROM (VALUES ('click', TIMESTAMP '2024-01-18'), ('view', TIMESTAMP '2024-01-10')) c(channel, last_check)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@CATALOG.add("watermark_delta", f"SELECT event_id FROM events LEFT JOIN ({CURSOR_SQL}) ON event_type = channel WHERE ts > coalesce(last_check, TIMESTAMP '{NOW}' - INTERVAL 3 DAY)")
def watermark_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.sql("SELECT channel, CAST(t AS TIMESTAMP) AS last_check FROM VALUES ('click', '2024-01-18'), ('view', '2024-01-10') AS c(channel, t)")
    return S.since(events(spark, sf_dir), c, "event_type", "ts", F.lit(NOW).cast("timestamp")).select("event_id")


@CATALOG.add("watermark_advance", f"SELECT event_type, max(ts) AS last_check, count(*) AS n FROM events LEFT JOIN ({CURSOR_SQL}) ON event_type = channel WHERE ts > coalesce(last_check, TIMESTAMP '{NOW}' - INTERVAL 3 DAY) GROUP BY event_type")
def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.sql("SELECT channel, CAST(t AS TIMESTAMP) AS last_check FROM VALUES ('click', '2024-01-18'), ('view', '2024-01-10') AS c(channel, t)")
    new = S.since(events(spark, sf_dir), c, "event_type", "ts", F.lit(NOW).cast("timestamp"))
    return new.groupBy("event_type").agg(F.max("ts").cast("timestamp_ntz").alias("last_check"), F.count(F.lit(1)).alias("n"))


@CATALOG.add("expected_absent", "SELECT u AS user_id, t AS event_type FROM (SELECT DISTINCT user_id AS u FROM events), (SELECT DISTINCT event_type AS t FROM events) WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = u AND event_type = t)")
def expected_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_type").distinct()
    kinds = e.agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    want = e.select("user_id").distinct().join(F.broadcast(kinds)).select("user_id", F.explode("k").alias("event_type"))
    return want.join(e, ["user_id", "event_type"], "left_anti")


@CATALOG.add("latest_by_key", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 10 <> 0")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_type", "event_id", "ts", "value", (F.col("event_id") % 10 == 0).alias("gone"))
    return S.latest(e, ["user_id", "event_type"], ["ts", "event_id"], "gone").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@CATALOG.add(
    "conditional_upsert",
    """WITH c AS (SELECT p_partkey AS k, p_size AS x, p_partkey % 3 + 1 AS version FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey AS k, p_size + 100 AS x, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 2 END AS if_version FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 = 0)
       SELECT coalesce(c.k, n.k) AS k, CASE WHEN n.k IS NOT NULL AND if_version IS NOT DISTINCT FROM version THEN n.x ELSE c.x END AS x, CASE WHEN n.k IS NOT NULL AND if_version IS NOT DISTINCT FROM version THEN coalesce(version, 0) + 1 ELSE version END AS version FROM c FULL JOIN n ON c.k = n.k""",
)
def conditional_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    current = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("x"), (F.col("p_partkey") % 3 + 1).alias("version"))
    new = p.where("p_partkey % 2 = 0 or p_partkey % 5 = 0").select(F.col("p_partkey").alias("k"), (F.col("p_size") + 100).alias("x"), F.when(F.col("p_partkey") % 5 != 0, F.lit(2).cast("long")).alias("if_version"), F.lit(1).alias("seq"))
    return S.upsert(current, new, "k", "version")


@CATALOG.add(
    "agenda_order",
    "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(orden, 999), o_orderdate, o_orderkey) AS INTEGER) AS place FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS orden FROM orders WHERE o_orderstatus <> 'F')",
)
def agenda_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").withColumn("orden", F.when(F.col("o_orderkey") % 4 != 0, F.substring("o_orderpriority", 1, 1).cast("int")))
    w = Window.partitionBy("o_custkey").orderBy(F.coalesce("orden", F.lit(999)), "o_orderdate", "o_orderkey")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@CATALOG.add("recent_closed", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS rank FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 15")
def recent_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return top(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], 15).select("o_orderkey", "rank")


@CATALOG.add(
    "calendar_grid",
    """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), c AS (SELECT month, month - CAST((isodow(month) - 1) AS INTEGER) AS s FROM m), d AS (SELECT month, s, CAST(n AS INTEGER) AS cell, s + CAST(n AS INTEGER) AS day FROM c, range(42) x(n)),
       k AS (SELECT * FROM d WHERE NOT (cell >= 35 AND s + 35 > last_day(month))), e AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT month, cell, k.day, coalesce(n, 0) AS n FROM k LEFT JOIN e ON e.day = k.day""",
)
def calendar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    grid = S.month_grid(o.select(F.trunc("day", "month").alias("m")).distinct(), "m")
    n = o.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, "day", "left").select("month", "cell", "day", F.coalesce("n", F.lit(0)).alias("n"))


@CATALOG.add("calendar_titles", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS items FROM events GROUP BY 1")
def calendar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("event_id")).alias("i"))
    return d.select("day", "n", F.md5(F.array_join(F.transform("i", lambda x: x.cast("string")), ",")).alias("items"))


@CATALOG.add("reindex", "SELECT o_custkey, o_orderkey, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n IS DISTINCT FROM o_orderkey % 9")
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 9).alias("place"))
    return S.renumber(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "place").select("o_custkey", "o_orderkey", "place")


@CATALOG.add("next_order", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def next_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(m, c["c_custkey"] == m["o_custkey"], "left").select("c_custkey", (F.coalesce("m", F.lit(0)) + 1).alias("next"))


@CATALOG.add(
    "day_labels",
    """SELECT event_id, CASE WHEN d < 0 THEN 'overdue' WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'tomorrow' WHEN d <= 6 THEN 'in ' || d || ' days' ELSE '' END AS label, lpad(CAST(CAST(round_even(value, 0) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(round_even(value, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS length
       FROM (SELECT event_id, value, date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS d FROM events WHERE value >= 0)""",
)
def day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.to_date("ts"), F.lit("2024-01-15").cast("date"))
    return events(spark, sf_dir).where("value >= 0").select("event_id", relative_day(days).alias("label"), duration(F.col("value")).alias("length"))


@CATALOG.add("notify_on_change", "SELECT user_id FROM (SELECT user_id, max(value) FILTER (ts < TIMESTAMP '2024-01-15') AS a, max(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS b FROM events GROUP BY user_id) WHERE a IS DISTINCT FROM b")
def notify_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    d = events(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(cut, F.col("value"))).alias("a"), F.max(F.when(~cut, F.col("value"))).alias("b"))
    return d.where(~F.col("a").eqNullSafe(F.col("b"))).select("user_id")


@CATALOG.add("channel_contradiction", "SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey FROM (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.o_custkey = b.o_custkey WHERE a.s IS DISTINCT FROM b.s")
def channel_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderkey") % 2 == i).groupBy("o_custkey").agg(F.max("o_orderstatus").alias(n)) for i, n in ((0, "a"), (1, "b")))
    return a.join(b, "o_custkey", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("o_custkey")
