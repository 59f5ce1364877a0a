import json

from heddle.operators.reports import report_lines


def flat(report):
    """The lines by walking the tree."""
    out = []

    def words(x):
        return x if isinstance(x, str) else x.get("text")

    def walk(block, place, depth):
        if isinstance(block, str):
            block = {"type": "paragraph", "text": block}
        kind, items = block.get("type", ""), block.get("items") or []
        one = {"paragraph": "paragraph", "subheading": "subheading"}
        if kind in one:
            out.append((place, depth, one[kind], block.get("text"), None))
        elif kind == "rich_paragraph":
            out.append((place, depth, "paragraph", "".join(map(words, block["runs"])), None))
        elif kind == "divider":
            out.append((place, depth, "divider", "— — —", None))
        elif kind in ("bullets", "numbered"):
            out.extend((place + [i + 1], depth, "bullet" if kind == "bullets" else "number", words(x), None) for i, x in enumerate(items))
        elif kind == "rich_bullets":
            out.extend((place + [i + 1], depth, "bullet", "".join(map(words, x["runs"] if isinstance(x, dict) else x)), None) for i, x in enumerate(items))
        elif kind == "table":
            out.append((place + [0], depth, "header", None, [words(c) for c in block["headers"]]))
            out.extend((place + [i + 1], depth, "row", None, [words(c) for c in r]) for i, r in enumerate(block["rows"]))
        elif kind == "info_box":
            out.append((place + [0], depth, "box", block.get("title"), None))
            for i, b in enumerate(block.get("paragraphs") or []):
                walk(b, place + [i + 1], depth + 1)
        else:
            out.append((place, depth, "unknown", kind, None))

    for s, section in enumerate(report["sections"]):
        if section.get("title"):
            out.append(([s, 0], 0, "heading", section["title"], None))
        for b, block in enumerate(section.get("blocks") or []):
            walk(block, [s, b + 1], 0)
    return sorted(out, key=lambda x: x[0])


def lines(spark, *texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, report string")
    return report_lines(d, "id", "report")


def test_every_type_at_any_depth(spark):
    box = {"type": "divider"}
    for n in range(7):
        box = {"type": "info_box", "title": f"t{n}", "color": "red", "paragraphs": ["say \"x\"\n", box, {"type": "bullets", "items": ["a", {"text": "b"}]}]}
    report = {"sections": [
        {"title": "One", "blocks": [{"type": "paragraph", "text": "p"}, {"type": "rich_paragraph", "runs": ["a", {"text": "b", "bold": True}]}, {"type": "subheading", "text": "s", "color": "blue"}, box]},
        {"blocks": [{"type": "rich_bullets", "items": [{"runs": ["x", {"text": "y"}]}, ["z", "w"]]}, {"type": "numbered", "items": ["1", "2"]}, {"type": "table", "headers": ["h", "i"], "rows": [["c", {"text": "d"}], ["e", "f"]]}, {"type": "chart"}, {"type": "table", "headers": [], "rows": []}]},
        {"title": "", "blocks": []},
    ]}
    got = lines(spark, json.dumps(report)).collect()
    assert sorted([(list(r.place), r.depth, r.kind, r.text, r.cells) for r in got], key=lambda x: x[0]) == flat(report)
    assert {r.color for r in got if r.kind == "box"} == {"red"} and max(r.depth for r in got) == 7


def test_odd_reports(spark):
    odd = ["", "{", None, "[]", "3", '{"sections": 4}', '{"sections": [{"title": "t"}, 5, {"blocks": "x"}, {"blocks": [7, null, {"type": "bullets"}, {"type": "info_box"}]}]}']
    got = sorted(((r.id, list(r.place), r.kind, r.text) for r in lines(spark, *odd).collect()), key=str)
    assert [g for g in got if g[2] != "unknown"] == [(6, [0, 0], "heading", "t"), (6, [3, 4, 0], "box", None)]
    assert lines(spark, *odd[:3]).count() == 0
