"""Queries over ordered points: a user's events in order of time, the hours since 2024 and the value as coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators import sequences as Q
from heddle.session import Catalog, table

CATALOG = Catalog()
ORDER = ["ts", "event_id"]
E_SQL = "SELECT event_id, user_id, ts, event_type, value, epoch(ts - TIMESTAMP '2024-01-01') / 3600.0 AS h, CASE WHEN event_id % 5 IN (1, 2) THEN NULL ELSE value END AS v FROM events"
W_SQL = "PARTITION BY user_id ORDER BY ts, event_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, event_type, value, h (hours), v (value with holes)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return e.withColumn("h", micros / 1000000.0 / 3600.0).withColumn("v", F.when(~(F.col("event_id") % 5).isin(1, 2), F.col("value")))


ARC_SQL = f"""SELECT event_id, user_id, ts, value, v, h, sum(d) OVER ({W_SQL} ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, coalesce(sqrt(pow(h - lag(h) OVER ({W_SQL}), 2) + pow(value - lag(value) OVER ({W_SQL}), 2)), 0) AS d FROM ({E_SQL}))"""


@CATALOG.add("arc_length", f"SELECT event_id, round(s, 4) AS s FROM ({ARC_SQL})")
def arc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.arc_length(events(spark, sf_dir), "user_id", ORDER, ["h", "value"]).select("event_id", F.round("s", 4).alias("s"))


@CATALOG.add("moving_avg", f"SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) < 3 THEN value ELSE avg(value) OVER ({W_SQL} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS avg_value FROM events")
def moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(Q.moving_average("value", "user_id", ORDER, 5), 6).alias("avg_value"))


_PASS = "SELECT event_id, user_id, ts, CASE WHEN lag(x) OVER ({w}) IS NULL OR lead(x) OVER ({w}) IS NULL THEN x ELSE (lag(x) OVER ({w}) + 2 * x + lead(x) OVER ({w})) / 4 END AS x FROM ({inner})"
SMOOTH_SQL = _PASS.format(w=W_SQL, inner=_PASS.format(w=W_SQL, inner="SELECT event_id, user_id, ts, value AS x FROM events"))


@CATALOG.add("smooth_121", f"SELECT event_id, round(x, 6) AS value FROM ({SMOOTH_SQL})")
def smooth_121(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.smooth(events(spark, sf_dir), "value", "user_id", ORDER, 2).select("event_id", F.round("value", 6).alias("value"))


@CATALOG.add(
    "tangent",
    f"""SELECT event_id, round(CASE WHEN n = 1 THEN 0 ELSE dh / greatest(sqrt(dh * dh + dv * dv), 1e-9) END, 6) AS th, round(CASE WHEN n = 1 THEN 1 ELSE dv / greatest(sqrt(dh * dh + dv * dv), 1e-9) END, 6) AS tv FROM (
        SELECT event_id, n, (h1 - h0) / f AS dh, (v1 - v0) / f AS dv FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n,
        coalesce(lead(h) OVER ({W_SQL}), h) AS h1, coalesce(lag(h) OVER ({W_SQL}), h) AS h0, coalesce(lead(value) OVER ({W_SQL}), value) AS v1, coalesce(lag(value) OVER ({W_SQL}), value) AS v0,
        CASE WHEN lead(h) OVER ({W_SQL}) IS NULL OR lag(h) OVER ({W_SQL}) IS NULL THEN 1.0 ELSE 2.0 END AS f FROM ({E_SQL})))""",
)
def tangent(spark: SparkSession, sf_dir: str) -> DataFrame:
    th, tv = Q.tangents(["h", "value"], "user_id", ORDER)
    return events(spark, sf_dir).select("event_id", F.round(th, 6).alias("th"), F.round(tv, 6).alias("tv"))


RUNS_SQL = f"""SELECT user_id, min(n) AS first, max(n) AS last, count(*) AS rows FROM (
  SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id, f ORDER BY ts, event_id) AS g, f FROM (
    SELECT user_id, ts, event_id, value > 50 AS f, row_number() OVER ({W_SQL}) - 1 AS n FROM events)) WHERE f GROUP BY user_id, g"""


@CATALOG.add("runs", f"SELECT user_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, rows FROM ({RUNS_SQL})")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.runs(events(spark, sf_dir), "user_id", ORDER, F.col("value") > 50)


@CATALOG.add("longest_run", f"SELECT user_id, rows, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rows DESC, first DESC) AS r FROM ({RUNS_SQL})) WHERE r = 1")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.longest_run(events(spark, sf_dir), "user_id", ORDER, F.col("value") > 50)


@CATALOG.add(
    "run_length",
    f"""WITH p AS (SELECT user_id, row_number() OVER ({W_SQL}) - 1 AS n, (h + coalesce(lag(h) OVER ({W_SQL}), h)) / 2 AS a, (h + coalesce(lead(h) OVER ({W_SQL}), h)) / 2 AS b FROM ({E_SQL}))
        SELECT r.user_id, CAST(r.first AS INTEGER) AS first, CAST(r.last AS INTEGER) AS last, round(q.b - p.a, 6) AS length FROM ({RUNS_SQL}) r JOIN p ON p.user_id = r.user_id AND p.n = r.first JOIN p q ON q.user_id = r.user_id AND q.n = r.last""",
)
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.run_length(events(spark, sf_dir), "user_id", ORDER, "h", F.col("value") > 50)
    return out.select("user_id", "first", "last", F.round("length", 6).alias("length"))


FILL_SQL = f"""SELECT event_id, user_id, h, CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (h - t0) / (t1 - t0) END AS filled FROM (
  SELECT *, last_value(v IGNORE NULLS) OVER ({W_SQL} ROWS UNBOUNDED PRECEDING) AS v0, first_value(v IGNORE NULLS) OVER ({W_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
  last_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER ({W_SQL} ROWS UNBOUNDED PRECEDING) AS t0, first_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER ({W_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM ({E_SQL}))"""


@CATALOG.add("gap_fill", f"SELECT event_id, round(filled, 6) AS filled FROM ({FILL_SQL})")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(Q.fill("v", "h", "user_id", ORDER), 6).alias("filled"))


ONE_SQL = f"SELECT user_id, h, max(value) AS value FROM ({E_SQL}) GROUP BY user_id, h"


@CATALOG.add(
    "resample_uniform",
    f"""WITH o AS ({ONE_SQL}), d AS (SELECT *, lead(h) OVER w AS b, lead(value) OVER w AS nv FROM o WINDOW w AS (PARTITION BY user_id ORDER BY h)),
        s AS (SELECT user_id, median(b - h) AS step, min(h) AS low, max(h) AS high FROM d GROUP BY user_id),
        t AS (SELECT user_id, low, step, unnest(range(CAST(floor((high - low) / step + 1e-6) AS BIGINT) + 1)) AS k FROM s WHERE step > 0),
        j AS (SELECT t.user_id, t.k, t.low + t.step * t.k AS x, d.* EXCLUDE (user_id) FROM t ASOF JOIN d ON t.user_id = d.user_id AND t.low + t.step * t.k + 1e-12 * t.step >= d.h)
        SELECT user_id, k, round(x, 5) AS h, round(value * (1 - w) + coalesce(nv, 0) * w, 5) AS value FROM (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE greatest(0, least(1, (x - h) / (b - h))) END AS w FROM j)""",
)
def resample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = events(spark, sf_dir).groupBy("user_id", "h").agg(F.max("value").alias("value"))
    return Q.resample(one, "user_id", "h", "value").select("user_id", "k", F.round("h", 5).alias("h"), F.round("value", 5).alias("value"))


@CATALOG.add(
    "sub_path",
    f"""WITH o AS ({ONE_SQL}), d AS (SELECT *, lead(h) OVER w AS b, lead(value) OVER w AS nv, greatest(100.0, min(h) OVER (PARTITION BY user_id)) AS e0, least(200.0, max(h) OVER (PARTITION BY user_id)) AS e1 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY h)),
        x AS (SELECT * FROM d WHERE e1 > e0)
        SELECT user_id, round(h, 6) AS h, round(value, 6) AS value FROM x WHERE h > e0 AND h < e1
        UNION ALL SELECT user_id, round(e0, 6), round(CASE WHEN b IS NULL THEN value ELSE value + (nv - value) * (e0 - h) / (b - h) END, 6) FROM x WHERE h <= e0 AND (b > e0 OR (b IS NULL AND h = e0))
        UNION ALL SELECT user_id, round(e1, 6), round(CASE WHEN b IS NULL THEN value ELSE value + (nv - value) * (e1 - h) / (b - h) END, 6) FROM x WHERE h <= e1 AND (b > e1 OR (b IS NULL AND h = e1))""",
)
def sub_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = events(spark, sf_dir).groupBy("user_id", "h").agg(F.max("value").alias("value"))
    return Q.sub_path(one, "user_id", "h", "value", 100.0, 200.0).select("user_id", F.round("h", 6).alias("h"), F.round("value", 6).alias("value"))


@CATALOG.add(
    "velocity_per_year",
    f"""SELECT event_id, round((value - lag(value) OVER w) / (nullif(date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)), 0) / 365.25), 9) AS per_year
        FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""",
)
def velocity_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy(*ORDER)
    days = F.datediff("ts", F.lag("ts").over(w))
    return events(spark, sf_dir).select("event_id", F.round((F.col("value") - F.lag("value").over(w)) / (F.nullif(days, F.lit(0)) / 365.25), 9).alias("per_year"))


@CATALOG.add(
    "page_starts",
    "SELECT conv_id, turn, CAST(1 + coalesce(sum(p) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' de ' || count(*) OVER (PARTITION BY conv_id) AS label FROM (SELECT conv_id, turn, greatest(1, CAST(ceil(length(text) / 100.0) AS BIGINT)) AS p FROM conversations)",
)
def page_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    pages = F.greatest(F.lit(1), F.ceil(F.length("text") / 100.0))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", pages.alias("p"))
    before = F.coalesce(F.sum("p").over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select("conv_id", "turn", (before + 1).cast("bigint").alias("start_page"), F.concat(F.row_number().over(w.orderBy("turn")).cast("string"), F.lit(" de "), F.count(F.lit(1)).over(w).cast("string")).alias("label"))


@CATALOG.add("strided_pick", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) WHERE n >= greatest(1, c // 8) // 2 AND (n - greatest(1, c // 8) // 2) % greatest(1, c // 8) = 0")
def strided_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About eight rows of each group: every N-th from N div 2."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("n"), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 8)).alias("step"))
    half = F.floor(F.col("step") / 2)
    return o.where((F.col("n") >= half) & ((F.col("n") - half) % F.col("step") == 0)).select("o_custkey", "o_orderkey")


@CATALOG.add(
    "extremes_with_place",
    """SELECT user_id, round(max(value), 6) AS most, arg_min(event_id, n) FILTER (value = hi) AS most_at, round(min(value), 6) AS least, arg_min(event_id, n) FILTER (value = lo) AS least_at FROM (
       SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, max(value) OVER (PARTITION BY user_id) AS hi, min(value) OVER (PARTITION BY user_id) AS lo FROM events) GROUP BY user_id""",
)
def extremes_with_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.groupBy("user_id").agg(
        F.round(F.max("value"), 6).alias("most"), F.min_by("event_id", F.struct(-F.col("value"), "ts", "event_id")).alias("most_at"),
        F.round(F.min("value"), 6).alias("least"), F.min_by("event_id", F.struct("value", "ts", "event_id")).alias("least_at"),
    )
