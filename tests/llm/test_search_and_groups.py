from collections import Counter

import numpy as np
import pytest

from heddle.llm import fingerprint, simhash, topk
from heddle.llm.components import components
from heddle.llm.work import Work

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], schema)


def test_topk_matches_brute_force_with_ties_nulls_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.1, 8)]) for i in range(450)]
    rows[7] = (7, None)
    rows[8] = (8, [0.1, None, *[0.0] * 6])
    rows[9] = (9, [float("nan")] + [0.0] * 7)
    rows[10] = (10, [float("inf")] + [0.0] * 7)
    rows[200] = (200, rows[100][1])
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # ties
    rows[12] = (None, rows[12][1])
    rows[13] = (13, rows[13][1][:5])
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "id long, vec array<float>, score int").repartition(5)
    got = sorted(tuple(r) for r in topk.topk(df, df.where("id % 100 = 0"), block=3).collect())
    assert got == brute.topk(rows)


def test_topk_with_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "id long, vec array<double>")
    assert [tuple(r) for r in topk.topk(df, df.where("id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 2 * 1024 * 1024), (0, 2, 2, -1024 * 1024)]
    assert topk.topk(df.limit(0), df.limit(0)).collect() == []
    lone = df.where("id = 0")
    assert topk.topk(lone, lone).collect() == []


def test_topk_is_exact_beyond_doubles(spark):
    rows = [(0, [2.0**18, 1.0]), (1, [2.0**18, 1.0]), (2, [2.0**18, 2.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = [(r.vec_id, r.score) for r in topk.topk(df, df.where("id = 0")).orderBy("rank").collect()]
    assert got == [(2, 2**56 + 2**21), (1, 2**56 + 2**20)]


def test_query_of_topk_matches_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in topk.op1_topk(spark, sf).collect()) == brute.topk(rows)


def test_bit_sliced_search_finds_all_pairs():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for i in range(0, 400, 4):
        fps[i + 1] = fps[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)))
    for radius in range(4):
        left, right = simhash.within(fps, fps, radius)
        want = {(i, j) for i in range(500) for j in range(500) if int(fps[i] ^ fps[j]).bit_count() <= radius}
        assert set(zip(left.tolist(), right.tolist())) == want


@pytest.mark.parametrize(("rows", "radius"), [(1, 0), (64, 80), (1000, 80), (333, 3), (200, 256)])
def test_bit_sliced_pairs_are_those_within_the_radius(rows, radius):
    rng = np.random.default_rng(rows)
    one = rng.integers(0, 1 << 64, (rows, 4), np.uint64)
    noise = np.packbits(rng.random((rows, 256)) < rng.random((rows, 1)) * 0.6, axis=1).view(np.uint64)
    noise[::3] = 0
    want = np.bitwise_count(noise).sum(axis=1) <= radius
    assert (simhash.near_pairs(one, one ^ noise, radius) == want).all() and want.any()


@pytest.mark.parametrize(("chunk", "many"), [(512, 1 << 25), (4, 1 << 25), (4, 0)])
def test_simhash_groups_match_brute_force_for_any_chunking(spark, sf, chunk, many):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts |= {1000 + i: texts[0] + f" w{i}" for i in range(30)} | {2000: "", 2001: None, 2002: " \n", 2003: "one two", 2004: "ONE  Two", 2005: "x " * 3000}
    d = docs_of(spark, texts.items()).repartition(3)
    work = Work(spark, "test")
    got = {r.id: (r.fp0, r.component_id) for r in simhash.groups(work.save(simhash.fingerprints(d)), work, chunk=chunk, many=many).collect()}
    want = {i: brute.simhash(t) for i, t in texts.items()}
    assert {i: f & (2**64 - 1) for i, (f, _) in got.items()} == want
    assert {i: c for i, (_, c) in got.items()} == brute.near({i: (f,) for i, f in want.items()})


def test_simhash_tables_link_what_any_table_links(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = texts[3].split()
    texts |= {1000 + i: " ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in range(0, 60, 3)}
    got = {r.id: r.component_id for r in simhash.simhash_groups(docs_of(spark, texts.items()), tables=4).collect()}
    want = brute.near({i: tuple(simhash.majorities(t, tables=4)) for i, t in texts.items()})
    assert got == want
    assert brute.simhash(texts[3]) == simhash.majorities(texts[3], tables=4)[0]


def test_simhash_edges(spark):
    assert simhash.simhash_groups(docs_of(spark, [(1, "a")]).limit(0)).collect() == []
    got = {(r.id, r.component_id) for r in simhash.simhash_groups(docs_of(spark, [(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "z")])).collect()}
    assert got == {(5, 5), (None, 5), (None, None)}


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 202), (202, 200), (300, 300), (400, None)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r.node: r.component for r in components(Work(spark, "test"), df).collect()}
    want = brute.groups([(a, b) for a, b in links if b is not None], {x for ab in links for x in ab if x is not None})
    assert got == {n: c for n, c in want.items() if n not in (300, 400)}
    assert components(Work(spark, "test"), df.limit(0)).collect() == []


def test_fingerprints_match_brute_force(spark):
    import hashlib

    texts = [(1, "the quick brown fox jumps over the lazy dog " * 3), (2, "Grün  ist\tdie Heide, sagt man so oft hier"), (4, ""), (7, None), (9, "one two three"), (11, "the quick brown fox jumps over the lazy dog " * 3), (12, " a b c d e ")]
    df = docs_of(spark, texts).repartition(3)
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    plain = [(i, t or "") for i, t in texts]
    for (i, t), (_, after) in zip(plain, plain[1:] + plain[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        f, e, n = brute.fingerprint(t), brute.fingerprint(edited), brute.fingerprint(after)
        share = lambda x, y: sum(x[8 * k : 8 * k + 8] == y[8 * k : 8 * k + 8] for k in range(32)) / 32
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e)
        assert r.near_edited == share(f, e) and r.near_next == share(f, n)
    assert got[1].fingerprint == got[11].fingerprint


def test_fingerprint_edges(spark):
    assert fingerprint.fingerprints(docs_of(spark, [(1, "a")]).limit(0)).collect() == []
    one = fingerprint.fingerprints(docs_of(spark, [(1, "a b c d")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert len(fingerprint.fingerprints(docs_of(spark, [(None, "b"), (None, "a")])).collect()) == 2
    twice = fingerprint.fingerprints(docs_of(spark, [(3, "x y"), (3, "x y"), (None, "z"), (1, "w " * 5000)]).withColumnRenamed("lang", "term")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in twice) == [(False, 1), (False, 3), (False, 3), (True, 0)]


def test_fingerprints_of_one_id_on_every_row_fall_in_many_ranges(spark):
    texts = [(i % 2 or None, f"w{i % 7} x{i % 3} a b c d e {i % 5}") for i in range(200)]
    got = fingerprint.fingerprints(docs_of(spark, texts).repartition(3)).collect()
    order = sorted(((i is None, t) for i, t in texts), key=lambda x: (x[0], x[1].encode()))
    want = Counter()
    for (none, t), (_, after) in zip(order, order[1:] + order[:1]):
        f, n = brute.fingerprint(t), brute.fingerprint(after)
        want[none, f, sum(f[8 * k : 8 * k + 8] == n[8 * k : 8 * k + 8] for k in range(32)) / 32] += 1
    assert Counter((r.doc_id is None, r.fingerprint, r.near_next) for r in got) == want


def test_fingerprint_likeness_estimates_jaccard(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fingerprint.op2_fingerprint(spark, sf).collect()}
    assert len(got) == len(rows)
    off = []
    for r, s in zip(rows, rows[1:] + rows[:1]):
        half = len(r.text) // 2
        bag = lambda t: Counter(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4)))
        a, b = bag(r.text), bag(r.text[: len(r.text) - half] + s.text[:half])
        off.append(got[r.doc_id].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.11
