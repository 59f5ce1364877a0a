"""Reports as trees of blocks: written out line by line, level by level, at any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.lineage import cut


def _get(v: str, path: str, kind: str = "string") -> str:
    return f"try_variant_get({v}, '$.{path}', '{kind}')"


def _text(v: str) -> str:
    """A string itself, or an object's text."""
    return f"if(schema_of_variant({v}) = 'STRING', try_variant_get({v}, '$', 'string'), {_get(v, 'text')})"


def _runs(v: str) -> str:
    """The texts of a list of runs, put together."""
    return f"array_join(transform(try_variant_get({v}, '$', 'array<variant>'), r -> coalesce({_text('r')}, '')), '')"


# The types of blocks. Each gives its lines as (place below the block's, kind, text, cells).
def _lines() -> Column:
    one = lambda kind, text: f"array(named_struct('below', cast(array() as array<long>), 'kind', '{kind}', 'text', {text}, 'cells', cast(null as array<string>)))"
    many = lambda kind, items, text: f"transform({items}, (x, i) -> named_struct('below', array(cast(i + 1 as long)), 'kind', '{kind}', 'text', {text}, 'cells', cast(null as array<string>)))"
    items = _get("block", "items", "array<variant>")
    cells = lambda v: f"transform(try_variant_get({v}, '$', 'array<variant>'), c -> {_text('c')})"
    row = lambda below, kind, of: f"named_struct('below', array({below}), 'kind', '{kind}', 'text', cast(null as string), 'cells', {of})"
    header = f"array({row('0L', 'header', cells(_get('block', 'headers', 'variant')))})"
    body = f"transform({_get('block', 'rows', 'array<variant>')}, (x, i) -> {row('cast(i + 1 as long)', 'row', cells('x'))})"
    runs = f"if(schema_of_variant(x) like 'OBJECT%', {_runs(_get('x', 'runs', 'variant'))}, {_runs('x')})"
    title = f"array(named_struct('below', array(0L), 'kind', 'box', 'text', {_get('block', 'title')}, 'cells', cast(null as array<string>)))"
    return F.expr(f"""CASE type
        WHEN 'paragraph' THEN {one('paragraph', _get('block', 'text'))} WHEN 'rich_paragraph' THEN {one('paragraph', _runs(_get('block', 'runs', 'variant')))}
        WHEN 'subheading' THEN {one('subheading', _get('block', 'text'))} WHEN 'divider' THEN {one('divider', "'— — —'")}
        WHEN 'bullets' THEN {many('bullet', items, _text('x'))} WHEN 'numbered' THEN {many('number', items, _text('x'))} WHEN 'rich_bullets' THEN {many('bullet', items, runs)}
        WHEN 'info_box' THEN {title} WHEN 'table' THEN concat({header}, coalesce({body}, array()))
        ELSE {one('unknown', 'type')} END""")


def report_lines(docs: DataFrame, key: str, report: str) -> DataFrame:
    """key, place, depth, kind, text, cells, color: the lines of reports (JSON text: sections of a title and blocks) in the order
    of their place, a list of numbers.

    kind is heading, paragraph, subheading, bullet, number, box (its title), header, row or divider; a block of another type is
    `unknown`, with the type as its text, and what is in it isn't looked at. Boxes hold paragraphs, or any blocks, at any
    depth: a level is one pass over the boxes of the level before, written down between. Lists that are missing or no lists
    give no lines; a report that is null or no JSON gives none; repeated keys are reports each, with the same key.
    """
    d = docs.select(key, F.expr(f"try_parse_json({report})").alias("report"))
    sections = d.select(key, F.expr("posexplode(try_variant_get(report, '$.sections', 'array<variant>')) AS (s, section)"))
    place = F.array(F.col("s").cast("long"))
    titles = sections.select(
        key, F.concat(place, F.array(F.lit(0).cast("long"))).alias("place"), F.lit(0).alias("depth"), F.lit("heading").alias("kind"), F.expr(_get("section", "title")).alias("text"),
        F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("string").alias("color"),
    ).where("text <> ''")
    found = [titles]
    level = sections.select(key, "s", F.expr("posexplode(try_variant_get(section, '$.blocks', 'array<variant>')) AS (b, block)"))
    level, depth = level.select(key, F.concat(place, F.array((F.col("b") + 1).cast("long"))).alias("place"), "block"), 0
    while True:
        level = level.withColumn("type", F.expr(f"if(schema_of_variant(block) = 'STRING', 'paragraph', coalesce({_get('block', 'type')}, ''))"))
        level = level.withColumn("block", F.expr("if(schema_of_variant(block) = 'STRING', parse_json(to_json(named_struct('text', try_variant_get(block, '$', 'string')))), block)"))
        lines = level.select(key, "place", F.expr(_get("block", "color")).alias("color"), F.explode(_lines()).alias("l"))
        found.append(lines.select(key, F.concat("place", "l.below").alias("place"), F.lit(depth).alias("depth"), "l.kind", "l.text", "l.cells", "color"))
        inner = level.where("type = 'info_box'").select(key, "place", F.expr(f"posexplode({_get('block', 'paragraphs', 'array<variant>')}) AS (b, inner)"))
        inner = inner.select(key, F.concat("place", F.array((F.col("b") + 1).cast("long"))).alias("place"), F.expr("to_json(inner)").alias("block"))
        inner, depth = cut(inner), depth + 1
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = inner.withColumn("block", F.expr("parse_json(block)"))
