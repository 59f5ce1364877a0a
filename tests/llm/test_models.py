import math
from collections import Counter

import numpy as np
import pyarrow as pa

from heddle.llm import labelled, ngram, packing, quality, token_counts, toxicity, words
from heddle.llm.work import Work

from . import brute


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts), "id long, text string")


def test_ngram_scores_match_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    train = [brute.word_list(t) + [ngram.END] for i, t in docs.items() if brute.remainder(i, 7) != 2]
    uni = Counter(w for x in train for w in x)
    n, v = sum(uni.values()), len(uni)
    pairs = Counter(p for x in train for p in zip([None, *x[:-1]], x))
    total, follow, contexts = Counter(), {1: Counter(), 2: Counter(), 3: Counter()}, Counter()
    for (a, b), c in pairs.items():
        total[a] += c
        follow[min(c, 3)][a] += 1
        contexts[b] += 1
    d = ngram.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    e = ngram.discounts([sum(c == k for c in contexts.values()) for k in (1, 2, 3, 4)])
    rest = sum(e[min(c, 3)] for c in contexts.values()) / len(pairs)

    def q(w):
        c = contexts[w]
        return (c - e[min(c, 3)]) / len(pairs) * (c > 0) + rest / (v + 1)

    def p(a, w):
        if not total[a]:
            return q(w)
        c = pairs[a, w]
        return (c - d[min(c, 3)]) / total[a] * (c > 0) + sum(d[k] * follow[k][a] for k in (1, 2, 3)) / total[a] * q(w)

    got = ngram.op6_language_model(spark, sf).collect()
    assert len(got) == len(docs)
    base = score = 0.0
    for r in got:
        x = brute.word_list(docs[r.doc_id]) + [ngram.END]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(x), sum(w in uni for w in x), n, brute.remainder(r.doc_id, 7) == 2)
        assert math.isclose(r.base_score, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, w)) for a, w in zip([None, *x[:-1]], x)), rel_tol=1e-9)
        if r.held_out:
            base, score = base + r.base_score, score + r.score
    assert score > base
    for a in (None, b"the", next(iter(total))):
        assert math.isclose(sum(p(a, w) for w in uni) + p(a, b"no such\nword"), 1.0, rel_tol=1e-9)


def test_ngram_tells_of_lost_files(spark):
    from glob import glob
    from os import rename

    import pytest

    d = docs_of(spark, [(i, f"w{i % 7} v{i % 5} u{i % 3} w{i % 7}") for i in range(40)])
    model = ngram.fit(d.select("text"), Work(spark, "test"))
    pairs = sorted(glob(model.root.replace("file://", "") + "/pair-*"))
    assert len(pairs) == len(model.buckets) > 1
    rename(pairs[0], pairs[0] + ".lost")
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        ngram.score(d, model).agg({"score": "sum"}).collect()


def test_ngram_with_no_training_and_odd_texts(spark):
    d = docs_of(spark, [(1, None), (2, ""), (3, "A a b"), (3, "A a b"), (None, "x"), (4, "w " * 4000)])
    empty = ngram.fit(d.limit(0).select("text"), Work(spark, "test"))
    got = ngram.score(d, empty).collect()
    assert {(r.n_tokens, r.n_known, r.base_score, r.score) for r in got} == {(1, 0, 0.0, 0.0), (4, 0, 0.0, 0.0), (2, 0, 0.0, 0.0), (4001, 0, 0.0, 0.0)}
    model = ngram.fit(d.select("text"), Work(spark, "test"))
    assert (model.tokens, model.size) == (1 + 1 + 4 + 4 + 2 + 4001, 5)
    assert all(r.score < 0 and math.isfinite(r.score) for r in ngram.score(d, model).collect())
    assert ngram.score(d.limit(0), model).collect() == []


def test_discounts_stay_inside_their_counts():
    for n in ([0, 0, 0, 0], [5, 0, 0, 0], [10, 4, 2, 1], [1, 10, 1, 10], [0, 3, 0, 2]):
        d = ngram.discounts(n)
        assert d[0] == 0 and all(0 < d[k] < k for k in (1, 2, 3))


def test_sample_is_bounded_reproducible_and_leaves_the_fold_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(5, "later")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(3, 1), (None, 1), (7, None), (900, 1)], "doc_id long, toxic int")
    rows, zeros, ones = labelled.sample(Work(spark, "test"), docs, labels, "toxic", 10, 20)
    got = {r.id: (r.text, r.y) for r in rows.collect()}
    again = {r.id: (r.text, r.y) for r in labelled.sample(Work(spark, "test"), docs.repartition(7), labels.repartition(3), "toxic", 10, 20)[0].collect()}
    assert got == again and sum(y for _, y in got.values()) == 20 and len(got) == 30
    assert all(brute.remainder(i, 5) != 0 for i in got)
    known = [i for i in range(150) if brute.remainder(i, 5) != 0]
    assert zeros == sum(i % 2 == 0 for i in known) and ones == sum(i % 2 for i in known)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    terms = pa.array([f"t{i}" for i in range(60)], pa.large_string())
    examples = [(i, int(rng.integers(2)), np.sort(rng.choice(60, m, replace=False)), rng.integers(1, 5, m).astype(float)) for i in range(700) for m in [int(rng.integers(0, 6))]]
    index = toxicity.Index(terms, rng.uniform(1, 5, 60), examples, (0.8, 0.2))
    dense = np.zeros((len(index.ids), 60))
    dense[np.repeat(np.arange(len(index.ids)), np.diff(index.begin)), index.at] = index.own
    for _ in range(200):
        at = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = index.weights(at, rng.integers(1, 4, len(at)).astype(float))
        q = np.zeros(60)
        q[at] = w
        full = dense @ q
        where, score = index.nearest(at, w)
        want = np.sort(full[full > 1e-12])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(score, want, atol=1e-9)
        assert np.allclose(full[where], score, atol=1e-9)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    assert all(got[i].held_out == (brute.remainder(i, 5) == 0) for i in got)
    assert brute.auc([got[i].score for i in held], [labels[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op9_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    assert brute.auc([got[i].score for i in held], [labels[i] for i in held]) > 0.97
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_models_with_nulls_ties_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you stupid clown"), (3, "you stupid clown"), (None, "x"), (4, "w " * 4000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pairs = docs.selectExpr("doc_id AS id", "text")
    index = toxicity.fit(docs, none, Work(spark, "test"))
    assert {r.score for r in toxicity.score(pairs, index).collect()} == {0.0}
    model = quality.fit(docs, none, Work(spark, "test"))
    assert len(quality.score(pairs, model).collect()) == 6
    one = spark.createDataFrame([(i, 1, 1) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(pairs, toxicity.fit(docs, one, Work(spark, "test"))).collect()} == {1.0}
    assert toxicity.score(pairs.limit(0), index).collect() == quality.score(pairs.limit(0), model).collect() == []


def test_quality_scores_are_the_features_mean(spark):
    rng = np.random.default_rng(5)
    model = quality.Model(rng.normal(0, 50, quality.BUCKETS), 0.25)
    for text in ("a b a b", "déjà vu vu vu", "one", "x" * 300, "w " * 50, ""):
        at, n = quality.features(text)
        logit = 0.25 + (model.odds[at] @ n / n.sum() if len(at) else 0)
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-max(-30, min(30, logit)))), rel_tol=1e-9)
        assert model.score(text) == model.score(text)


def test_toxicity_matches_brute_force(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in texts}
    train = sorted(i for i in labels if brute.remainder(i, 5))

    def terms(text):
        found = Counter()
        for w in text.lower().split():
            w = w.strip(toxicity.EDGE)
            found.update([w] * (w != "") + [w[:4] + "~"] * (len(w) > 4) + [w[:5] + "~"] * (len(w) > 5))
        return found

    own = {i: terms(t) for i, t in texts.items()}
    df = Counter(t for c in own.values() for t in c)
    n = [sum(labels[i] == y for i in train) for y in (0, 1)]
    have = [Counter(t for i in train if labels[i] == y for t in own[i]) for y in (0, 1)]

    def weight(t):
        a, b = have[1][t] + 0.5, have[0][t] + 0.5
        c, d = n[1] + 1 - a, n[0] + 1 - b
        z = abs(math.log(a * d / b / c)) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        return (math.log((1 + len(texts)) / (1 + df[t])) + 1) * math.log1p(math.exp(4 * (z - 3))) / 4

    known = {t: weight(t) for t in {t for i in train for t in own[i]}}

    def vector(c):
        v = {t: (1 + math.log(k)) * known[t] for t, k in c.items() if t in known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {i: vector(own[i]) for i in train if own[i]}
    share = [n[0] / len(train), n[1] / len(train)]
    vote = {i: share[labels[i]] / n[labels[i]] * len(train) for i in vectors}

    def odds(v, skip=None):
        near = sorted(((sum(x * u.get(t, 0) for t, x in v.items()), i) for i, u in vectors.items() if i != skip), reverse=True)[: toxicity.NEIGHBOURS]
        v = [(s**4 * vote[i], labels[i]) for s, i in near if s > 0]
        p = (sum(x for x, y in v if y) + 0.05 * share[1]) / (sum(x for x, _ in v) + 0.05)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    x = np.array([[odds(v, i), 1.0] for i, v in vectors.items()])
    y, w, a = np.array([labels[i] for i in vectors]), np.array([vote[i] for i in vectors]), np.array([1.0, 0.0])
    w = w / w.mean()
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ a))
        a = a - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (w * (p - y)) + a - [1.0, 0.0])
    got = {r.doc_id: r.score for r in toxicity.op7_toxicity(spark, sf).collect()}
    assert sorted(got) == sorted(texts)
    for i, c in own.items():
        assert math.isclose(got[i], 1 / (1 + math.exp(-a[0] * odds(vector(c)) - a[1])), rel_tol=1e-4, abs_tol=1e-6)


def test_quality_query_is_training_and_scoring_of_whole_texts(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in texts}
    train = sorted(i for i in labels if brute.remainder(i, 5))
    n = Counter(labels[i] for i in train)
    assert n[0] <= quality.ZEROS and n[1] <= quality.ONES  # so every label is learned from, with weight one
    odds, offset = quality.train([(*quality.features(texts[i]), labels[i], 1.0) for i in train])
    got = {r.doc_id: r for r in quality.op9_quality(spark, sf).collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        at, k = quality.features(t)
        want = 1 / (1 + math.exp(-(offset + (odds[at] @ k / k.sum() if len(at) else 0))))
        assert math.isclose(got[i].score, want, rel_tol=1e-6) and got[i].predicted == (got[i].score >= 0.3)


def test_portions_of_a_batch_are_read_as_texts_of_their_own():
    texts = ["", None, "One two ONE", "  ", "ü Three\tfour two.", "x" * 50, "five"] * 40
    whole = pa.array(texts)
    own = [pa.array(texts[i:j]) for i, j in words.portions(whole, 60)]
    cut = [whole[i:j] for i, j in words.portions(whole, 60)]
    assert len(cut) > 20 and sum(map(len, cut)) == len(texts)
    ids, counts = packing.WordIds(packing.tokenizer_path()), token_counts.Counter([("▁", -1.0), ("o", -2.0), ("two", -3.0)])
    for a, b in zip(own, cut):
        plain = [brute.word_list(t) for t in a.to_pylist()]
        codes, sizes, h = ngram.words_of(b)
        assert sizes.tolist() == list(map(len, plain)) and h[codes].tolist() == [ngram.hash_of(w) for t in plain for w in t]
        assert all(x.tolist() == y.tolist() for x, y in zip(toxicity.counted(a)[:3], toxicity.counted(b)[:3]))
        assert list(ids(a)) == list(ids(b)) == [np.array(ids.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in a.to_pylist()]
        assert np.concatenate([*counts.counts(b)]).tolist() == [counts(t or "") for t in a.to_pylist()]
