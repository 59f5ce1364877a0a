"""The near-copy stage against all pairs of exact five-word shingle sets."""

from itertools import combinations

import numpy as np
import pytest

from heddle.llm import near, stages
from heddle.llm.work import Work

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = brute.word_list(text)
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def exact(texts):
    sets = {i: grams(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return {i for i, g in brute.groups(links, texts).items() if g == i}


def edited(text, seed, share):
    rng = np.random.default_rng(seed)
    return " ".join(f"v{seed}x{k}" if rng.random() < share else w for k, w in enumerate(text.split()))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS).repartition(3)


def texts_of(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    long = [i for i, t in texts.items() if len(t.split()) > 150][:30]
    texts |= {1000 + 10 * k + e: edited(texts[i], 10 * k + e, (0.01, 0.02, 0.03, 0.05)[e]) for k, i in enumerate(long) for e in range(4)}
    return texts | {5000: "", 5001: None, 5002: " \n", 5003: "one two", 5004: "ONE  Two", 5005: "one two three"}


def test_stage_drops_what_is_alike_by_exact_sets_and_nothing_else(spark, sf):
    texts = texts_of(spark, sf)
    got = [r.doc_id for r in stages.drop_near_copies(spark, docs_of(spark, texts), sf).collect()]
    assert sorted(got) == sorted(exact(texts))


@pytest.mark.parametrize("chunk", [512, 3])
def test_chains_and_refused_links_for_any_chunking(spark, chunk):
    base = [f"w{i}" for i in range(120)]
    put = lambda *at: " ".join(f"n{i}" if i in at else w for i, w in enumerate(base))
    texts = {i: put(*[10 * k + 5 for k in range(12) if i >> k % 6 & 1][:3]) for i in range(1, 40)}
    texts |= {100 + i: put(5 * i + 3, 5 * i + 40, 100) for i in range(12)}
    want = exact(texts)
    assert 1 < len(want) < len(texts)
    assert {r.id for r in near.kept(docs_of(spark, texts), "doc_id", Work(spark, "test"), chunk).collect()} == want
    assert near.kept(docs_of(spark, texts).limit(0), "doc_id", Work(spark, "test")).collect() == []


def test_relinked_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(60, rng.integers(40, 58), replace=False)).astype(np.uint64) for _ in range(80)]
    links = [(a, b) for a, b in combinations(range(80), 2) if near.alike(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
    a, b = near.relinked(np.arange(80), sets, np.arange(80))
    assert set(zip(a, b)) <= {x for l, r in links for x in ((l, r), (r, l))}
    assert brute.groups(list(zip(a, b)), range(80)) == brute.groups(links, range(80))


def test_pairs_at_the_threshold_are_nearly_always_candidates():
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(600):
        x = rng.integers(0, 1 << 64, 360, np.uint64)
        one, two = np.unique(x[:324]), np.unique(x[36:])  # 288 of 360
        missed += not set(near.bands(one)) & set(near.bands(two))
    assert missed <= 1
