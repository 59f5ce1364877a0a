"""Small cases worked out by hand."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heddle.functions import clinical as C
from heddle.functions import markup as M
from heddle.functions import text as X
from heddle.functions.geo import box, haversine
from heddle.operators import graph, measures, rules, sequences, series, state, voxels
from heddle.operators import ranking as R


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text(spark):
    lit = F.lit
    assert one(spark, X.clean(lit("  a \n b "))) == ("a b",)
    assert one(spark, F.array_sort(X.tokens(lit("Study of HER-2+ gastric cancer, a")))) == (["gastric", "her"],)
    assert one(spark, *[X.date_ordinal(lit(t)) for t in ("2025-03", "", "0001-01-01", "2024-02-30")]) == (0, 0, 1, 0)
    assert one(spark, X.alias(lit("CO"), X.STATES), X.alias(lit(" usa"), X.COUNTRIES), X.alias(lit("Peru"), X.COUNTRIES)) == ("Colorado", "United States", "Peru")
    assert one(spark, *X.clock(lit("082727.5343")), *X.clock(lit("08")), *X.clock(lit("x"))) == ("08:27:27", 30447, "08:00:00", 28800, "", None)
    assert one(spark, X.phase_hints(lit("Fase Arterial y portal")), X.phase_hints(lit("tórax"))) == (["arterial", "portal/venosa"], [])
    assert one(spark, *X.excluded(lit("bazo+dil:2")), *X.excluded(lit("higado"))) == ("bazo", 2, "higado", 0)
    assert one(spark, *[X.relative_day(lit(d)) for d in (-1, 0, 1, 6, 7)]) == ("overdue", "today", "tomorrow", "in 6 days", "")
    assert one(spark, X.slug(lit("  Ñandú & co. ")), X.slug(lit("日本"))) == ("nandu_co", "x")
    assert one(spark, X.escape_html(lit("<a b='1' c=\"2\">&"))) == ("&lt;a b=&#x27;1&#x27; c=&quot;2&quot;&gt;&amp;",)
    assert one(spark, *X.rgb(lit("#fa0")), *X.bounds(lit(":5"))) == (255, 170, 0, None, 5.0)
    assert one(spark, X.duration(lit(90.5)), X.truncate(lit("abc  def"), 5, "!"), X.truncate(lit("abc"), 5, "!")) == ("01:30", "abc!", "abc")
    assert one(spark, X.near(lit(" ")), X.near(lit("34.05, -118.24"))["lat"]) == (None, 34.05)
    with pytest.raises(Exception, match="not LAT,LON"):
        one(spark, X.near(lit("95,0"))["lat"])


def test_distance(spark):
    lit = F.lit
    assert one(spark, F.round(haversine(lit(0.0), lit(0.0), lit(0.0), lit(180.0)), 3), haversine(lit(0.0), lit(0.0), lit(None).cast("double"), lit(1.0))) == (round(3958.8 * 3.141592653589793, 3), None)
    points = spark.range(0, 181 * 361, 7).select((F.floor(F.col("id") / 361) - 90).cast("double").alias("lat"), (F.col("id") % 361 - 180).cast("double").alias("lon"))
    for at, miles in (((34.0, -118.0), 900.0), ((89.0, 0.0), 200.0), ((0.0, 179.5), 400.0)):
        near = points.where(haversine(lit(at[0]), lit(at[1]), F.col("lat"), F.col("lon")) <= miles)
        assert near.count() == near.where(box(F.col("lat"), F.col("lon"), at, miles)).count() > 0


def test_ranking(spark):
    a = lambda *p: F.array(*map(F.lit, p)) if p else F.array().cast("array<string>")
    assert one(spark, R.phase_priority(a("PHASE2", "PHASE3")), R.phase_priority(a("PHASE4")), R.phase_priority(a())) == (5, 0, 0)
    assert one(spark, R.is_open(F.lit(""), F.lit("RECRUITING")), R.is_open(F.lit("COMPLETED"), F.lit("RECRUITING")), R.matches(F.lit("PERU"), "peru "), R.matches(F.lit("x"), " ")) == (True, False, True, True)


def test_clinical(spark):
    lit = F.lit
    assert one(spark, *[C.bucket(lit(x), C.KIDNEY) for x in (60.0, 59.0, 15.0, 14.9)]) == ("G2", "G3a", "G4", "G5")
    assert one(spark, *[C.bucket(lit(x), C.AGES) for x in (11, 12, 64, 65, 75)]) == ("child", "adolescent", "middle", "early elderly", "late elderly")
    panel = [("70 - 100", (132, 118, 109)), ("< 5.7 (goal < 7.0)", (7.4, 6.9, 6.6)), ("0.7 - 1.3", (1.1, 1.2, 1.1)), ("< 200", (212, 188, 171)), ("< 100", (128, 104, 92)), ("> 40", (41, 44, 46)), ("< 150", (178, 151, 139)), ("150 - 450", (231, 240, 228))]
    flags = [one(spark, *[C.flag(lit(float(v)), lit(ref)) for v in values]) for ref, values in panel]
    assert [[f != "normal" for f in x] for x in zip(*flags)] == [[True, True, False, True, True, False, True, False], [True, True, False, False, True, False, True, False], [True, True, False, False, False, False, False, False]]
    assert one(spark, C.flag(lit(None).cast("double"), lit("1 - 2")), C.bucket(lit(None).cast("double"), C.KIDNEY)) == (None, None)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_sequences(spark):
    d = table(spark, [(1, i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 5.0])], "g int, n int, v double")
    avg = d.select("n", sequences.moving_average("v", "g", ["n"], 3).alias("a"), sequences.moving_average("v", "g", ["n"], 2).alias("b")).orderBy("n").collect()
    assert [r.a for r in avg] == [r.b for r in avg] == [1.5, 2, 3, 4, 4.5]
    assert [r.v for r in sequences.smooth(table(spark, [(1, 0, 0.0), (1, 1, 4.0), (1, 2, 0.0)], "g int, n int, v double"), "v", "g", ["n"]).orderBy("n").collect()] == [0, 2, 0]
    f = table(spark, [(1, i, b) for i, b in enumerate([False, True, True, False, True])], "g int, n int, f boolean")
    assert [tuple(r)[1:] for r in sequences.runs(f, "g", ["n"], F.col("f")).orderBy("first").collect()] == [(1, 2, 2), (4, 4, 1)]
    t = table(spark, [(1, i, i in (0, 1, 4, 5)) for i in range(6)], "g int, n int, f boolean")
    assert tuple(sequences.longest_run(t, "g", ["n"], F.col("f")).first()) == (1, 2, 4, 5)
    h = table(spark, [(1, 0.0, 1.0), (1, 2.0, None), (1, 4.0, 3.0), (1, 9.0, None)], "g int, s double, v double")
    assert [r[0] for r in h.select(sequences.fill("v", "s", "g", ["s"]).alias("x"), "s").orderBy("s").collect()] == [1, 2, 3, 3]
    r = sequences.resample(table(spark, [(1, float(x), float(x) * 2) for x in (0, 1, 2, 4, 5)], "g int, s double, v double"), "g", "s", "v").orderBy("k").collect()
    assert [(x.k, x.s, x.v) for x in r] == [(i, float(i), 2.0 * i) for i in range(6)]


def test_series(spark):
    d = table(spark, [("a", float(x)) for x in (0, 1, 2, 4, 5)] + [("b", float(x)) for x in (0, 1, 1, 2)] + [("c", 1.0)], "g string, x double")
    got = {r.g: (r.step, r.duplicates, r.verdict) for r in series.spacing(d, "g", "x").collect()}
    assert got == {"a": (1.0, 0, "irregular (1 huecos)"), "b": (1.0, 1, "1 posiciones repetidas"), "c": (None, 0, "-")}
    none = F.lit(None).cast("double")
    w = lambda te, tr, ti: series.weighting(F.lit(""), F.lit(""), none, te, tr, ti)
    assert one(spark, w(F.lit(10.0), F.lit(500.0), none), w(F.lit(90.0), F.lit(3000.0), none), w(none, none, F.lit(200.0))) == ("T1", "T2", "STIR")


def mask(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "vol long, k int, j int, i int").repartition(2)


def places(df):
    return {tuple(r)[1:4] for r in df.select("vol", "k", "j", "i").collect()}


def test_voxels(spark):
    full = {(0, j, i) for j in range(3) for i in range(3)}
    assert places(voxels.erode(mask(spark, full), (1, 3, 3))) == full
    assert places(voxels.erode(mask(spark, full - {(0, 0, 0)}), (1, 3, 3))) == full - {(0, 0, 0), (0, 0, 1), (0, 1, 0)}
    assert len(places(voxels.dilate(mask(spark, [(1, 1, 1)]), (3, 3, 3)))) == 7
    two = mask(spark, [(0, 0, 0), (0, 1, 1)])
    assert voxels.label(two, (1, 2, 2)).select("label").distinct().count() == voxels.label_small(two, (1, 2, 2)).select("label").distinct().count() == 2
    ring = full - {(0, 1, 1)}
    assert places(voxels.fill_slices(mask(spark, ring), (1, 3, 3), spark.createDataFrame([(1,)], "vol long"))) == full
    line = mask(spark, [(0, 0, i) for i in range(9)])
    seed = mask(spark, [(0, 0, 4)])
    assert places(voxels.grow(line, seed, (1, 1, 9), steps=2)) == {(0, 0, i) for i in range(2, 7)}


def test_components_of_a_long_path_and_strings(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("z1", "z2")], "a string, b string").repartition(4)
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert set(got.values()) == {"n000", "z1"} and len(got) == 73


def test_rules_and_measures(spark):
    d = spark.createDataFrame([(1, 0.0, 4.0)], "id int, n double, r double")
    assert tuple(measures.wall(d, "n", "r", 1.0, 1.0).select("outer_radius", "thickness").first()) == (4.0, 0.0)
    c = spark.createDataFrame([(1, 0, 0, 0), (2, 39, 0, 0), (3, 40, 0, 0), (4, 79, 1, 0)], "id int, r int, g int, b int")
    assert {(r.a, r.b) for r in rules.near_colours(c, "id", "r", "g", "b", 40).collect()} == {(1, 2), (2, 3), (3, 4)}


def test_state(spark):
    rows = spark.createDataFrame([("x", datetime.datetime(2024, 1, d)) for d in (6, 8)], "c string, ts timestamp")
    none = spark.createDataFrame([], "channel string, last_check timestamp")
    assert [r.ts.day for r in state.since(rows, none, "c", "ts", F.lit("2024-01-10").cast("timestamp")).collect()] == [8]
    may = state.month_grid(spark.createDataFrame([(datetime.date(2026, 5, 1),), (datetime.date(2026, 2, 1),)], "m date"), "m").groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("d"))
    assert {(r.month.month, r.n, r.d) for r in may.collect()} == {(5, 35, datetime.date(2026, 4, 27)), (2, 35, datetime.date(2026, 1, 26))}


def test_markup():
    html = '<div class="ad">a<div class="ad">b</div></div><p>c</p><br class="ad"/><div class="ad">open'
    assert [html[i:j] for i, j, _, _ in M.outermost(html, lambda t, a: "ad" in (a.get("class") or ""))] == ['<div class="ad">a<div class="ad">b</div></div>', '<br class="ad"/>']
    assert M.without_comments('{"a": 1, "_b": 2, "c": [{"_d": 1, "e": null}]}') == '{"a":1,"c":[{"e":null}]}'


def test_follow_a_lumen(spark):
    from heddle.operators import paths

    rows = [(1, 0, 1, [1, 2, 3], 0.0, 0.0), (1, 0, 2, [9], 5.0, 5.0), (1, 1, 3, [3, 4], 0.5, 0.0), (1, 1, 4, [1], 0.0, 0.0), (1, 3, 5, [40], 9.0, 9.0), (1, 4, 6, [4], 1.0, 0.0), (1, 4, 7, [50, 51], 8.0, 8.0)]
    d = spark.createDataFrame(rows, "vol long, slice int, piece long, cells array<int>, ca double, cb double")
    assert [(r.slice, r.piece, r.gap) for r in paths.follow(d, 1.5).orderBy("slice").collect()] == [(0, 1, False), (1, 3, False), (2, -1, True), (3, -1, True), (4, 6, False)]


def test_frames_stay_unit_and_upright(spark):
    from heddle.operators import paths

    d = spark.createDataFrame([(1, i, float(i), float(i * i) / 10, 0.0) for i in range(8)], "path long, n int, x double, y double, z double")
    rows = paths.frames(d).orderBy("n").collect()
    assert all(abs(r.nx**2 + r.ny**2 + r.nz**2 - 1) < 1e-9 for r in rows) and all(abs(r.nz) > 0.999 for r in rows)


def balanced(html, name, wanted):
    """Outermost elements by counting `<name` and `</name` from each wanted opening, comments blanked out."""
    import re

    html = re.sub(r"<!--.*?-->", lambda m: " " * len(m[0]), html, flags=re.S)
    found, done = [], 0
    for m in re.finditer(rf"<{name}\b[^>]*>", html):
        if m.start() < done or not wanted(m[0]):
            continue
        depth = 0
        for x in re.finditer(rf"<(/?){name}\b[^>]*>", html[m.start() :]):
            depth += -1 if x[1] else 1
            if not depth:
                done = m.start() + x.end()
                found.append((m.start(), done))
                break
    return found


def test_outer_elements_and_cuts_of_all_pages_by_counting(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    ad = lambda tag: 'class="ad"' in tag
    got = {}
    for r in entry.queries()["outer_elements"](spark, sf).collect():
        got.setdefault(r.page_id, []).append((r.begin, r.end))
    for i, html in pages.items():
        assert sorted(got.get(i, [])) == balanced(html, "div", ad), i
    for name in ("section", "article", "main", "nav", "p"):
        for html in list(pages.values())[:200]:
            assert [x[:2] for x in M.outermost(html, lambda t, _, name=name: t == name)] == balanced(html, name, lambda _: True)
    assert any(got.values())


def test_markup_edges():
    cut = lambda t, w: M.cut_out(t, M.outermost(t, w))
    nav = lambda t, _: t == "nav"
    assert cut("a<NAV x='>'>b<nav>c</nav></nav >d<nav>open", nav) == "ad<nav>open"
    assert cut("<!-- <nav>x</nav> --><script>'<nav>'</script>y</nav>", nav) == "<!-- <nav>x</nav> --><script>'<nav>'</script>y</nav>"
    assert cut(None, nav) is None and M.outermost("", nav) == []
    assert M.outermost("<p a=1 B='x &amp; y' c>z</p>", lambda t, _: t == "p")[0][3] == {"a": "1", "b": "x & y", "c": None}
    assert [x[2] for x in M.elements_of("<div><param name=a><br></div>")] == ["div", "param", "br"]


def test_images_with_bad_data_do_not_stop_the_others(spark):
    block = lambda data: {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": data}}
    texts = [json.dumps({"content": [block("YWJj"), {"deep": [block("abc"), block(7), block("")]}]}), "{broken", None]
    got = M.json_images(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").orderBy("place").collect()
    assert [(r.place, r.bytes) for r in got] == [(0, 3), (1, None), (2, None), (3, 0)]


def test_paragraphs_and_wrapping(spark):
    import textwrap

    d = spark.createDataFrame([("a\nb\n\nc",), ("\n\n \n\n",), ("one two three four " * 9 + "x" * 30,)], "t string")
    assert [r[0] for r in d.select(X.paragraphs("t")).collect()][:2] == [["a\nb", "c"], []]
    for width in (5, 20, 31):
        for r in d.select("t", X.wrapped("t", width).alias("w")).collect():
            assert r.w == textwrap.wrap(" ".join(r.t.split()), width, break_long_words=False, break_on_hyphens=False)


def test_components_of_small_volumes_are_those_of_the_edges(spark):
    import random

    random.seed(4)
    rows = [(v, k, j, i) for v in range(30) for k in range(3) for j in range(4) for i in range(5) if random.random() < 0.5]
    d = spark.createDataFrame(rows, "vol long, k int, j int, i int").repartition(3)
    for plane in (False, True):
        want = {tuple(r) for r in voxels.label(d, (3, 4, 5), plane).collect()}
        assert {tuple(r) for r in voxels.label_small(d, (3, 4, 5), plane).collect()} == want
    assert voxels.label_small(d.limit(0), (3, 4, 5)).collect() == []


def test_first_seen_takes_whole_rows_and_missing_keys(spark):
    from heddle.operators import series

    d = spark.createDataFrame([(1, None, "b"), (1, 2, "a"), (None, 3, "c"), (None, 1, "d")], "k int, n int, v string")
    assert {tuple(r) for r in series.first_seen(d, ["k"], [F.col("n")]).collect()} == {(1, None, "b"), (None, 1, "d")}


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from heddle import work

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://a:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work.shared_root(session)
