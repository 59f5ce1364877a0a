"""Queries over pages, texts and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import markup as M
from heddle.functions import text as X
from heddle.operators.series import first_seen
from heddle.session import Catalog, table

CATALOG = Catalog()


@CATALOG.add("outer_elements")
def outer_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form: elements nest without bound."""
    return M.elements(table(spark, sf_dir, "pages"), "page_id", "html", "ad").select(F.col("key").alias("page_id"), "place", "tag", "begin", "end")


@CATALOG.add("strip_private")
def strip_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form: elements nest without bound."""
    d = M.without(table(spark, sf_dir, "pages"), "page_id", "html", css="ad", attribute="data-privado", tags=("script", "style", "nav"))
    return d.select(F.col("key").alias("page_id"), F.length("html").alias("n_chars"), F.md5("html").alias("digest"))


@CATALOG.add("tab_sections")
def tab_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form: elements nest without bound. Every page's outermost sections, articles or mains, by id."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(k, n, tag, a.get("id"), i, j - i) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (i, j, tag, a) in enumerate(M.outermost(t, lambda tag, _: tag in ("section", "article", "main")))]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "place", "tag", "id", "begin", "size"])

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id long, place int, tag string, id string, begin int, size int")


@CATALOG.add(
    "paragraphs",
    "SELECT doc_id, CAST(n AS INTEGER) AS n, md5(p) AS digest FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS l FROM documents))",
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs are parted by a blank line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.paragraphs("text")).alias("n", "p")).select("doc_id", (F.col("n") + 1).alias("n"), F.md5("p").alias("digest"))


@CATALOG.add(
    "glossary_terms",
    "SELECT item_id, CAST(p AS INTEGER) AS place, trim(a) AS term FROM (SELECT item_id, unnest(l) AS a, generate_subscripts(l, 1) AS p FROM (SELECT item_id, string_split(array_to_string(string_split(text, ' '), '|'), '|') AS l FROM benchmark))",
)
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases separated by bars: here the words of each item."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.split("text", " "), "|").alias("aliases"))
    return t.select("item_id", F.posexplode(F.split("aliases", r"\|")).alias("place", "term")).select("item_id", (F.col("place") + 1).alias("place"), F.trim("term").alias("term"))


@CATALOG.add(
    "log_parse",
    r"""SELECT event_id, regexp_extract(l, '\[(\w+)\]', 1) AS level, CAST(regexp_extract(l, 'k=(\d+)', 1) AS INTEGER) AS k, regexp_extract(l, 'user:(\d+)', 1) AS who FROM (
        SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '[ERROR]' ELSE '[INFO]' END || ' user:' || user_id || ' k=' || json_extract_string(props, '$.k') AS l FROM events)""",
)
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("event_id") % 7 == 0, "[ERROR]").otherwise("[INFO]"), F.lit(" user:"), F.col("user_id").cast("string"), F.lit(" k="), F.get_json_object("props", "$.k"))
    d = table(spark, sf_dir, "events").select("event_id", line.alias("l"))
    return d.select("event_id", F.regexp_extract("l", r"\[(\w+)\]", 1).alias("level"), F.regexp_extract("l", r"k=(\d+)", 1).cast("int").alias("k"), F.regexp_extract("l", r"user:(\d+)", 1).alias("who"))


@CATALOG.add("props_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def props_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", T.StructType().add("k", T.IntegerType())).alias("p")).select("event_id", "p.k")


@CATALOG.add("json_images", "SELECT conv_id, turn, md5(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes FROM conversations")
def json_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text packed as an image block two levels down, and found again."""
    c = table(spark, sf_dir, "conversations")
    source = F.struct(F.lit("base64").alias("type"), F.lit("text/plain").alias("media_type"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("data"))
    block = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("image").alias("type"), source.alias("source"))).alias("content")).alias("message")))
    d = M.json_images(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), block.alias("j")), "key", "j")
    return d.select(F.floor(F.col("key") / 1000).alias("conv_id"), (F.col("key") % 1000).alias("turn"), "digest", "bytes")


@CATALOG.add("content_hash_dedup", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY conv_id, turn) AS r FROM conversations WHERE role = 'assistant') WHERE r = 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("h"))
    return first_seen(d, ["h"], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn")


@CATALOG.add("transcript_filter", "SELECT event_id FROM events WHERE event_type <> 'view' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-10'")
def transcript_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps are compared as text; a missing one is empty and so falls out."""
    stamp = F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return table(spark, sf_dir, "events").where((F.col("event_type") != "view") & (stamp >= "2024-01-10")).select("event_id")


@CATALOG.add("transcript_join", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id")
def transcript_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("s"), F.count(F.lit(1)).alias("turns")).select("conv_id", F.md5(F.array_join(F.col("s.t"), "\n")).alias("digest"), "turns")


@CATALOG.add(
    "legend_groups",
    "SELECT p_brand, CAST(row_number() OVER (ORDER BY first, p_brand) AS INTEGER) AS place, n, names FROM (SELECT p_brand, min(p_partkey) AS first, count(*) AS n, md5(string_agg(p_name, ';' ORDER BY p_partkey)) AS names FROM part GROUP BY p_brand)",
)
def legend_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in order of first sight, their rows in order; the groups are few, as brands are."""
    from pyspark.sql import Window

    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("s"))
    return g.select("p_brand", F.row_number().over(Window.orderBy("first", "p_brand")).alias("place"), "n", F.md5(F.array_join(F.col("s.p_name"), ";")).alias("names"))


@CATALOG.add("marker_fill", "SELECT s_suppkey, 'Name: ' || s_name || ' {{x}} at ' || s_nationkey || '.' AS text FROM supplier")
def marker_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = M.fill_markers("Name: {{a}} at {{b}}.", {"a": F.concat("s_name", F.lit(" {{x}}")), "b": F.col("s_nationkey")})
    return table(spark, sf_dir, "supplier").select("s_suppkey", filled.alias("text"))
