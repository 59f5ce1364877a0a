"""Reports as trees of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.reports import report_lines
from heddle.session import Catalog, table

CATALOG = Catalog()


@CATALOG.add(
    "report_tree",
    """WITH p AS (SELECT p_partkey, p_name, p_size, p_partkey % 4 AS d FROM part), t AS (SELECT *, unnest(range(d)) AS t FROM p)
       SELECT p_partkey, '0.0' AS place, 0 AS depth, 'heading' AS kind, p_name AS text, NULL AS cells FROM p
       UNION ALL SELECT p_partkey, '0.1', 0, 'paragraph', 'size ' || p_size, NULL FROM p
       UNION ALL SELECT p_partkey, '0.2.' || i, 0, 'bullet', p_name || ' ' || i, NULL FROM p, range(1, 3) r(i)
       UNION ALL SELECT p_partkey, '0.3.' || i, 0, CASE i WHEN 0 THEN 'header' ELSE 'row' END, NULL, CASE i WHEN 0 THEN 'part|size' ELSE p_name || '|' || p_size END FROM p, range(2) r(i)
       UNION ALL SELECT p_partkey, '0.4' || repeat('.2', t) || '.0', t, 'box', 'box ' || d - t, NULL FROM t
       UNION ALL SELECT p_partkey, '0.4' || repeat('.2', t) || '.1', t + 1, 'paragraph', 'in ' || d - t, NULL FROM t
       UNION ALL SELECT p_partkey, '0.4' || repeat('.2', d), d, 'divider', '— — —', NULL FROM p""",
)
def report_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each part, with boxes up to three deep."""
    text = lambda *parts: F.concat(F.lit(chr(34)), *parts, F.lit(chr(34)))
    box, boxes = '{"type": "divider"}', []
    for n in range(4):
        boxes.append(box)
        box = f'{{"type": "info_box", "title": "box {n + 1}", "paragraphs": ["in {n + 1}", {box}]}}'
    deep = F.element_at(F.array(*[F.lit(b) for b in boxes]), (F.col("p_partkey") % 4 + 1).cast("int"))
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    report = F.concat(
        F.lit('{"sections": [{"title": '), text(name), F.lit(', "blocks": [{"type": "rich_paragraph", "runs": ["size ", {"text": '), text(size), F.lit(', "bold": true}]}, {"type": "bullets", "items": ['),
        text(name, F.lit(" 1")), F.lit(', {"text": '), text(name, F.lit(" 2")), F.lit('}]}, {"type": "table", "headers": ["part", "size"], "rows": [['), text(name), F.lit(', {"text": '), text(size), F.lit("}]]}, "), deep, F.lit("]}]}"),
    )
    lines = report_lines(table(spark, sf_dir, "part").select("p_partkey", report.alias("report")), "p_partkey", "report")
    return lines.select("p_partkey", F.array_join("place", ".").alias("place"), "depth", "kind", "text", F.array_join("cells", "|").alias("cells"))
