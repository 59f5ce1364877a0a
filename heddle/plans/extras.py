"""Built-in operations that have no counterpart to match; kept apart so that they are never counted as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.session import Catalog, table

CATALOG = Catalog()


@CATALOG.add("extra_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extra_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@CATALOG.add("extra_ranks", "SELECT s_suppkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS INTEGER) AS t FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000))")
def extra_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey")
    o = w.orderBy(F.floor(F.col("s_acctbal") / 1000))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.rank().over(o).alias("r"), F.dense_rank().over(o).alias("d"), F.ntile(4).over(w.orderBy("s_acctbal", "s_suppkey")).alias("t"))


@CATALOG.add("extra_asof", "SELECT e.event_id, d.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) d ON e.user_id = d.user_id AND e.ts >= d.ts")
def extra_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view at or before each click, by one window over both."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view')").select("user_id", "ts", "event_id", "event_type")
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("before", F.last(view, True).over(w)).where("event_type = 'click'").select("event_id", "before")


@CATALOG.add("extra_tumbling", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def extra_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("event_type", F.window("ts", "1 day").alias("w"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "v")


@CATALOG.add("extra_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def extra_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    who = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    d = line.select("l_orderkey", "l_extendedprice", "l_discount").join(who, F.col("l_orderkey") == F.col("o_orderkey"))
    each = d.groupBy("c_nationkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return each.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("r", 2).alias("revenue"))
