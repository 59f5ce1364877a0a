"""Error-correcting output codes: the model against plain Python, odd texts, and labels held out."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from heddle.llm import language
from heddle.llm.language import BITS, BUCKETS, PRIOR, RUNS, SURE

from . import brute


def runs(text):
    """Buckets of a text's runs, from the description: bytes of a word between blanks, ends included once."""
    low = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (text or "").lower()).split(" ")
    found = []
    for w in (x for x in low if x):
        t = b" " + w.encode() + b" "
        for n in RUNS:
            for i in range(len(t) - n + 1):
                part = t[i : i + n]
                if b" " in part[1:-1] or part == b"  ":
                    continue
                key = int.from_bytes(part, "big")
                h = (key ^ (key >> 15) ^ (n * 0x01000193)) & 0xFFFFFFFF
                found.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS))
    return found


def trained(rows):
    """langs, codewords, odds and weights of (lang, text) rows."""
    counts = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(runs(text))
    langs = sorted(x for x in counts if counts[x])
    code = language.codewords(len(langs))
    share = {x: (lambda total: {h: (counts[x][h] + PRIOR) / total for h in range(BUCKETS)})(sum(counts[x].values()) + PRIOR * BUCKETS) for x in langs}
    used = {h for x in langs for h in counts[x]}
    mean = lambda h, some: sum(share[x][h] for x in some) / len(some)
    sides = [([x for x, c in zip(langs, code[:, b]) if c > 0], [x for x, c in zip(langs, code[:, b]) if c < 0]) for b in range(code.shape[1])]
    odds = {h: [math.log(mean(h, yes)) - math.log(mean(h, no)) for yes, no in sides] for h in used}
    seen, hits = Counter(), Counter()
    for lang, text in rows:
        bits = average(odds, runs(text), code.shape[1])
        if bits and lang in langs:
            seen[lang] += 1
            for b, v in enumerate(bits):
                hits[lang, b] += v * code[langs.index(lang), b] > 0
    weight = [[max(2 * (hits[x, b] + 0.5) / (seen[x] + 1) - 1, 1e-3) for b in range(code.shape[1])] for x in langs]
    return langs, code, odds, [[w / sum(r) * len(r) for w in r] for r in weight]


def average(odds, found, width):
    known = [odds[h] for h in found if h in odds]  # a run that nobody taught has the same odds on both sides, but for PRIOR
    return [sum(o[b] for o in known) / len(found) for b in range(width)] if found else []


def told(model, text):
    langs, code, odds, weight = model
    found = runs(text)
    z = [v * math.sqrt(min(len(found), SURE)) for v in average(odds, found, code.shape[1])]
    loss = [sum(w * np.logaddexp(0, -c * v) for w, c, v in zip(weight[i], code[i], z)) for i in range(len(langs))]
    best = loss.index(min(loss))
    return langs[best], 1 / sum(math.exp(min(loss) - x) for x in loss)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def test_model_equals_plain_python(spark, documents):
    rows = [(r.lang, r.text[:400]) for r in documents[:60]] + [(None, "aaa"), ("en", None), ("xx", "1 2 3")]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    langs, code, odds, weight = trained([r for r in rows if None not in r])
    assert model.langs == langs and "xx" not in langs
    assert np.allclose(model.weight, weight)
    for h in list(odds)[::50]:
        assert np.allclose(model.odds[h], odds[h], atol=1e-5)
    texts = [r.text[:300] for r in documents[60:120]] + ["a", "É", "der", "x1y2"]
    got = [(x, s) for part in model.predict(pa.array(texts)) for x, s in zip(part[0], part[1])]
    untaught = [h for h in set(runs("x1y2")) if h not in odds]
    for (x, s), text in zip(got, texts):
        if not untaught or set(runs(text)) <= set(odds):
            want = told((langs, code, odds, weight), text)
            assert x == want[0] and math.isclose(s, want[1], rel_tol=1e-3)


def test_odd_texts_repeats_and_clashing_columns(spark):
    rows = [("a", "lorem ipsum dolor")] * 3 + [("b", "wzk wzk kzw")] * 3
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    texts = [(1, None), (2, ""), (3, " 12, 34! "), (4, "LOREM"), (4, "LOREM"), (None, "kzw"), (5, "wzk " * 60000), (6, "lorem " * 3), (7, "中")]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in texts], "id long, text string, lang_pred string, score double").repartition(3)
    got = language.predict(df, model)
    assert got.columns == ["id", "lang_pred", "score", "ambiguous"]
    found = sorted(((r.id or 0, r.lang_pred) for r in got.collect()))
    assert found == [(0, "b"), (1, "und"), (2, "und"), (3, "und"), (4, "a"), (4, "a"), (5, "b"), (6, "a"), (7, found[-1][1])] and found[-1][1] in ("a", "b")
    assert all(0 <= r.score <= 1 and (r.score == 0 and r.ambiguous if r.lang_pred == "und" else r.score > 0.3) for r in got.collect())
    assert language.predict(df.limit(0), model).collect() == []


def test_nothing_learned_one_language_and_many(spark):
    schema = "lang string, text string"
    for rows in ([], [(None, "abc")], [("a", None)], [("a", "123")]):
        none = language.fit(spark.createDataFrame(rows, schema))
        assert [tuple(r) for r in language.predict(spark.createDataFrame([(1, "abc")], "id long, text string"), none).collect()] == [(1, "und", 0.0, True)]
    one = language.fit(spark.createDataFrame([("a", "abc")], schema))
    assert [tuple(r) for r in language.predict(spark.createDataFrame([(1, "xyz")], "id long, text string"), one).collect()] == [(1, "a", 1.0, False)]
    many = [(f"l{i:02}", " ".join(chr(97 + i) + chr(97 + j) + chr(97 + i) for j in range(20))) for i in range(20)]
    model = language.fit(spark.createDataFrame(many, schema))
    assert len(model.langs) == 20 and model.code.shape[1] > 20
    got = language.predict(spark.createDataFrame([(i, t[:24]) for i, (_, t) in enumerate(many)], "id long, text string"), model).collect()
    assert {r.id: r.lang_pred for r in got} == {i: x for i, (x, _) in enumerate(many)}


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 8, 30):
        code = language.codewords(n)
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= {2: 1, 3: 2, 4: 4, 7: 32, 8: 5, 30: 10}[n]
        assert all(abs(code[:, b].sum()) < n for b in range(code.shape[1]))


def test_a_flipped_bit_is_corrected():
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, np.zeros((BUCKETS, code.shape[1]), np.float32))
    for c in range(4):
        for b in range(code.shape[1]):
            z = code[c].copy()
            z[b] *= -1
            assert model.losses(z[None, :], np.array([SURE])).argmin() == c


def test_query_on_labels_held_out(spark, sf, documents):
    got = {r.doc_id: r for r in language.op13_language(spark, sf).collect()}
    assert len(got) == len(documents)
    held = [r for r in documents if brute.remainder(r.doc_id, 4) == 2]
    assert {i for i, r in got.items() if r.held_out} == {r.doc_id for r in held}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
