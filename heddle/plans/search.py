"""Queries of text functions, relevance, sites and stable rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.functions.geo import haversine
from heddle.operators import ranking as R
from heddle.operators import results as E
from heddle.session import Catalog, table

CATALOG = Catalog()
CONDITION, TERMS = "the and of nation", "with entlich tion"
# Fixed value: what a cut text ends with.
NOTICE = "\n[Truncated. Read the full criteria at the study link or rerun with --full-criteria.]"
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
PHASES = ["PHASE3", "PHASE2", "PHASE1", "PHASE4"]


def sql_tokens(c: str) -> str:
    clean = f"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'))"
    return f"list_filter(list_distinct(regexp_extract_all(lower({clean}), '[a-z0-9]+')), lambda t: len(t) > 1 AND NOT list_contains([{STOP}], t))"


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as studies: the first line is the title, the source's letters the one intervention."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        F.array("source").alias("interventions"),
        F.array(F.element_at(F.array(F.lit("DRUG"), F.lit("OTHER")), (F.col("doc_id") % 2 + 1).cast("int"))).alias("kinds"),
        F.array(F.element_at(F.array(*map(F.lit, PHASES)), (F.col("doc_id") % 4 + 1).cast("int"))).alias("phases"),
        F.when(F.col("doc_id") % 3 == 0, "RECRUITING").when(F.col("doc_id") % 3 == 1, "COMPLETED").otherwise("NOT_YET_RECRUITING").alias("status"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")), "yyyy-MM-dd").alias("updated"),
    )


STUDIES_SQL = """
SELECT doc_id, split_part(text, chr(10), 1) AS title, text, source,
       CASE WHEN doc_id % 2 = 0 THEN 'DRUG' ELSE 'OTHER' END AS kind,
       ['PHASE3', 'PHASE2', 'PHASE1', 'PHASE4'][doc_id % 4 + 1] AS phase,
       CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS priority,
       CASE doc_id % 3 WHEN 0 THEN 'RECRUITING' WHEN 1 THEN 'COMPLETED' ELSE 'NOT_YET_RECRUITING' END AS status,
       CAST(DATE '2024-01-01' + CAST(doc_id % 500 AS INTEGER) AS VARCHAR) AS updated
FROM documents
"""


def _sql_hits(words: str, c: str) -> str:
    return f"len(list_intersect({sql_tokens(repr(words))}, {sql_tokens(c)}))"


SUPPORT = " OR ".join(f"contains(lower(trim(regexp_replace(title, '{SPACE}', ' ', 'g'))) || ' ' || lower(source), '{m}')" for m in R.SUPPORTIVE)
SCORED_SQL = f"""
SELECT *, 3 * {_sql_hits(CONDITION, 'title')} + 2 * {_sql_hits(CONDITION, 'source')} + least(3, {_sql_hits(CONDITION, 'text')})
       + 5 * {_sql_hits(TERMS, 'title')} + 3 * {_sql_hits(TERMS, 'source')} + 2 * {_sql_hits(TERMS, 'text')} + priority
       + CASE WHEN kind = 'DRUG' THEN 4 ELSE 0 END + CASE WHEN status = 'RECRUITING' THEN 2 ELSE 0 END
       - CASE WHEN {SUPPORT} THEN 4 ELSE 0 END AS score
FROM ({STUDIES_SQL})
"""
ORDER_SQL = "score DESC, CASE WHEN status = 'RECRUITING' THEN 0 ELSE 1 END, priority DESC, updated DESC, doc_id"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return studies(spark, sf_dir).withColumn("score", R.relevance(c("title"), c("interventions"), c("text"), c("phases"), c("kinds"), c("status"), CONDITION, TERMS))


@CATALOG.add("relevance_topk", f"SELECT doc_id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (ORDER BY {ORDER_SQL}) AS INTEGER) AS rank FROM ({SCORED_SQL}) ORDER BY {ORDER_SQL} LIMIT 10")
def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = R.rank_order(F.col("score"), F.col("status"), F.col("phases"), F.col("updated"), F.col("doc_id"))
    slim = scored(spark, sf_dir).select("doc_id", "score", "status", "phases", "updated")
    return R.top(slim, order, 10).select("doc_id", F.col("score").cast("int").alias("score"), "rank")


@CATALOG.add("relevance_score", f"SELECT doc_id, CAST(score AS INTEGER) AS score FROM ({SCORED_SQL})")
def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", F.col("score").cast("int").alias("score"))


@CATALOG.add(
    "stable_rank",
    f"SELECT status, doc_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY {ORDER_SQL.replace('score DESC, ', '')}) AS r FROM ({STUDIES_SQL})) WHERE r <= 20",
)
def stable_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = R.rank_order(F.lit(0), F.col("status"), F.col("phases"), F.col("updated"), F.col("doc_id"))[1:]
    place = F.row_number().over(Window.partitionBy("status").orderBy(*order))
    return studies(spark, sf_dir).select("status", "doc_id", place.alias("rank")).where("rank <= 20")


@CATALOG.add("token_sets", f"SELECT doc_id, CAST(len({sql_tokens('text')}) AS INTEGER) AS n_tokens FROM documents")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"))


@CATALOG.add("token_overlap", f"SELECT doc_id, CAST({_sql_hits(CONDITION, 'text')} AS INTEGER) AS hits FROM documents")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.size(F.array_intersect(X.tokens(F.lit(CONDITION)), X.tokens(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits"))


@CATALOG.add("clean_text", f"SELECT item_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS text FROM benchmark")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", X.clean(F.col("text")).alias("text"))


def _sql_map(names: dict) -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in names.items())
    return "MAP {" + pairs + "}"


@CATALOG.add(
    "alias_lookup",
    f"""WITH a AS (SELECT s_suppkey, substr(n_name, 1, 2) AS st, CASE s_suppkey % 4 WHEN 0 THEN 'USA' WHEN 1 THEN ' U.K. ' WHEN 2 THEN 'South  Korea' ELSE n_name END AS co
        FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        b AS (SELECT s_suppkey, st, trim(regexp_replace(co, '\\s+', ' ', 'g')) AS co FROM a)
        SELECT s_suppkey, coalesce({_sql_map(X.STATES)}[lower(st)], st) AS state, coalesce({_sql_map(X.COUNTRIES)}[lower(co)], co) AS country FROM b""",
)
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 4
    country = F.when(k == 0, "USA").when(k == 1, " U.K. ").when(k == 2, "South  Korea").otherwise(F.col("n_name"))
    return d.select("s_suppkey", X.alias(F.substring("n_name", 1, 2), X.STATES).alias("state"), X.alias(country, X.COUNTRIES).alias("country"))


@CATALOG.add(
    "truncate_notice",
    "SELECT doc_id, CAST(length(t) AS INTEGER) AS kept_chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN length(text) > 2000 THEN "
    f"regexp_replace(substr(text, 1, 2000), '\\s+$', '') || chr(10) || '{NOTICE.strip()}' ELSE coalesce(text, '') END AS t FROM documents)",
)
def truncate_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 2000, NOTICE).alias("t"))
    return t.select("doc_id", F.length("t").alias("kept_chars"), F.md5("t").alias("digest"))


@CATALOG.add(
    "date_ordinal",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE CAST(date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS INTEGER) END AS ordinal FROM orders""",
)
def date_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 3
    shown = F.when(k == 0, F.substring(full, 1, 7)).when(k == 1, "").otherwise(full)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.date_ordinal(shown).cast("int").alias("ordinal"))


AT = (34.05, -118.24)
SITES_SQL = """SELECT s_suppkey, n_name, r_name, CAST((s_suppkey * 37) % 181 - 90 AS DOUBLE) AS lat, CAST((s_suppkey * 53) % 361 - 180 AS DOUBLE) AS lon,
  CASE s_suppkey % 4 WHEN 0 THEN 'RECRUITING' WHEN 1 THEN '' WHEN 2 THEN 'COMPLETED' ELSE NULL END AS status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
MILES_SQL = "2 * 3958.8 * asin(sqrt(pow(sin((radians(lat) - radians(34.05)) / 2), 2) + cos(radians(34.05)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(-118.24)) / 2), 2)))"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("s_suppkey") % 4
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "s_suppkey", "n_name", "r_name",
            ((F.col("s_suppkey") * 37) % 181 - 90).cast("double").alias("lat"), ((F.col("s_suppkey") * 53) % 361 - 180).cast("double").alias("lon"),
            F.when(k == 0, "RECRUITING").when(k == 1, "").when(k == 2, "COMPLETED").alias("status"),
        )
    )


@CATALOG.add("geo_radius_sites", f"SELECT s_suppkey, round({MILES_SQL}, 6) AS miles FROM ({SITES_SQL}) WHERE {MILES_SQL} <= 2500")
def geo_radius_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.within_miles(sites(spark, sf_dir), "lat", "lon", AT, 2500).select("s_suppkey", F.round("miles", 6).alias("miles"))


@CATALOG.add("site_distance_order", f"SELECT s_suppkey, CAST(m AS INTEGER) AS miles, CAST(row_number() OVER (ORDER BY m, s_suppkey) AS INTEGER) AS rank FROM (SELECT s_suppkey, round_even({MILES_SQL}, 0) AS m FROM ({SITES_SQL})) ORDER BY m, s_suppkey LIMIT 25")
def site_distance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sites(spark, sf_dir).select("s_suppkey", F.bround(haversine(F.lit(AT[0]), F.lit(AT[1]), F.col("lat"), F.col("lon")), 0).alias("m"))
    return R.top(d, [F.coalesce("m", F.lit(0)).asc(), F.col("s_suppkey").asc()], 25).select("s_suppkey", F.col("m").cast("int").alias("miles"), "rank")


@CATALOG.add(
    "site_open",
    f"SELECT s_suppkey FROM ({SITES_SQL}) WHERE CASE WHEN coalesce(status, '') <> '' THEN status IN ('RECRUITING', 'NOT_YET_RECRUITING', 'ENROLLING_BY_INVITATION') ELSE s_suppkey % 2 = 1 END AND lower(r_name) = 'asia'",
)
def site_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = F.when(F.col("s_suppkey") % 2 == 1, "RECRUITING").otherwise("COMPLETED")
    return sites(spark, sf_dir).where(R.is_open(F.col("status"), study) & R.matches(F.col("r_name"), " Asia ")).select("s_suppkey")


@CATALOG.add(
    "site_semi",
    f"SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN ({SITES_SQL}) ON l_suppkey = s_suppkey WHERE l_orderkey = o_orderkey AND {MILES_SQL} <= 1500)",
)
def site_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = R.within_miles(sites(spark, sf_dir), "lat", "lon", AT, 1500).select("s_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(near, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@CATALOG.add("phase_priority", f"SELECT doc_id, CAST(priority AS INTEGER) AS priority FROM ({STUDIES_SQL})")
def phase_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies(spark, sf_dir).select("doc_id", R.phase_priority(F.col("phases")).cast("int").alias("priority"))


@CATALOG.add("supportive_marker", "SELECT doc_id, contains(lower(text), 'survey') OR contains(lower(text), 'exercise') OR contains(lower(text), 'tion') AS hit FROM documents")
def supportive_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.any_marker(F.lower("text"), ("survey", "exercise", "tion")).alias("hit"))


@CATALOG.add("parse_near", "SELECT s_suppkey, lat, lon FROM (" + SITES_SQL + ") WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 5 = 0")
def parse_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("lat").cast("string"), F.lit(", "), F.col("lon").cast("string")))
    return sites(spark, sf_dir).select("s_suppkey", X.near(shown).alias("p")).select("s_suppkey", "p.lat", "p.lon")


@CATALOG.add("result_envelope", f"SELECT doc_id, CAST(n AS BIGINT) AS matched FROM (SELECT doc_id, score, status, priority, updated, count(*) OVER () AS n FROM ({SCORED_SQL}) WHERE status <> 'COMPLETED') ORDER BY {ORDER_SQL} LIMIT 10")
def result_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count before the limit is a sum of its own: counting over a window would bring all rows to one task."""
    kept = scored(spark, sf_dir).where("status <> 'COMPLETED'")
    order = R.rank_order(F.col("score"), F.col("status"), F.col("phases"), F.col("updated"), F.col("doc_id"))
    first = kept.select("doc_id", "score", "status", "phases", "updated").orderBy(*order).limit(10).select("doc_id")
    return first.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("matched"))))


CUT_SQL = "CASE WHEN length(text) > 2000 THEN regexp_replace(substr(text, 1, 2000), '\\s+$', '') || chr(10) || '[Truncated. Read the full criteria at the study link or rerun with --full-criteria.]' ELSE coalesce(text, '') END"
PREVIEW_SQL = SCORED_SQL.replace(STUDIES_SQL, f"SELECT * REPLACE ({CUT_SQL} AS text) FROM ({STUDIES_SQL})")


@CATALOG.add(
    "search_results",
    f"""WITH k AS (SELECT * FROM ({PREVIEW_SQL}) WHERE status <> 'COMPLETED'), f AS (SELECT doc_id, CAST(score AS INTEGER) AS score, row_number() OVER (ORDER BY {ORDER_SQL}) AS r FROM k ORDER BY r LIMIT 10)
        SELECT n AS result_count_before_limit, n > 500 AS search_truncated, ids, scores, CASE WHEN n > 500 THEN 'The search matched more studies than this tool retrieves. Narrow the condition, terms, or location to see everything relevant.' END AS truncation_note,
               CAST(NULL AS VARCHAR) AS hint, '{CONDITION}' AS condition, CAST(NULL AS VARCHAR) AS near, length('{E.WARNING}') AS warned
        FROM (SELECT count(*) AS n FROM k), (SELECT string_agg(doc_id, ',' ORDER BY r) AS ids, string_agg(score, ',' ORDER BY r) AS scores FROM f)""",
)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria are cut before they are scored, as they are shown; the whole envelope is one row."""
    c = F.col
    s = studies(spark, sf_dir).withColumn("text", E.criteria(c("text")))
    s = s.withColumn("score", R.relevance(c("title"), c("interventions"), c("text"), c("phases"), c("kinds"), c("status"), CONDITION, TERMS))
    kept = s.where("status <> 'COMPLETED'").select("doc_id", "score", "status", "phases", "updated")
    order = R.rank_order(c("score"), c("status"), c("phases"), c("updated"), c("doc_id"))
    more = kept.agg((F.count(F.lit(1)) > 500).alias("truncated"))
    d = E.envelope(kept, order, E.echo(CONDITION, TERMS), 10, more)
    listed = lambda f: F.array_join(F.transform("results", lambda r: r.getField(f).cast("string")), ",")
    return d.select(
        "result_count_before_limit", "search_truncated", listed("doc_id").alias("ids"), listed("score").alias("scores"), "truncation_note", "hint",
        F.get_json_object("search", "$.condition").alias("condition"), F.get_json_object("search", "$.near").alias("near"), F.length("warning").cast("long").alias("warned"),
    )


@CATALOG.add("site_status_note", f"""SELECT s_suppkey, CASE WHEN coalesce(status, '') <> '' THEN status ELSE 'not listed (study is RECRUITING)' END AS status FROM ({SITES_SQL})""")
def site_status_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = X.clean(F.col("status"))
    return sites(spark, sf_dir).select("s_suppkey", F.when(own != "", own).otherwise(F.lit("not listed (study is RECRUITING)")).alias("status"))


@CATALOG.add(
    "text_helpers",
    r"""SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped,
        CASE WHEN regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'x'
             ELSE regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS slug FROM benchmark""",
)
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark")
    return t.select("item_id", X.escape_html("text").alias("escaped"), X.slug("text").alias("slug"))
