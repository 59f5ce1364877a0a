"""Alignment of two tokenizers against their own libraries and plain Python."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from heddle.llm import alignment
from heddle.llm.packing import tokenizer_path
from heddle.llm.work import Work

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(alignment.BYTES))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.PIECES))


def both(tools, text):
    """[(id, begin, end)] of each side, as the libraries tokenise the whole text."""
    a, b = tools
    if not text:
        return [], []
    from tokenizers.decoders import ByteLevel  # noqa: F401  the entries' letters, by the library's own table

    letters = {}
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = 0
    for x in range(256):
        if x in own:
            letters[chr(x)] = x
        else:
            letters[chr(256 + extra)] = x
            extra += 1
    raw = (" " + text).encode()
    x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    y = [(i, piece(i)) for i in b.encode(text)]
    if b"".join(t for _, t in x) != raw or b"".join(t for _, t in y) != raw:
        return [], []
    out = []
    for side in (x, y):
        at, rows = 0, []
        for i, t in side:
            rows.append((i, at, at + len(t)))
            at += len(t)
        out.append(rows)
    return out


def brute(tools, docs):
    found = [(i, *both(tools, t)) for i, t in docs]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for _, a, b in found]
    held = Counter(p for own in links for p in set(own))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, a, b), own in zip(found, links):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(x[0]) for x in side if lo < x[2] <= hi) for side in (a, b)))
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(cuts), len(own), sum(held[p] == most[p[0]] for p in own), sum(held[p] for p in own), sha))
    return sorted(out, key=repr)


def got(spark, docs, schema="doc_id long, text string", **kw):
    df = spark.createDataFrame(docs, schema).repartition(3)
    return sorted((tuple(r) for r in alignment.align(df, Work(spark, "test"), **kw).select(COLUMNS).collect()), key=repr)


ODD = [
    None, "", " ", "   ", "\n", "a\n", "\n\na", " a  b ", "a\tb\r\nc", "a b c", "a  b", "x　 y", "é à ù \u0085 z", "naïve café — “quoted”", "日本語 テキスト と", "🙂 🙃🙂",
    "▁ mark", "a▁b c", "<|endoftext|> and <s> </s> <unk> <0x41>", "it's  I'll 've\n'd", "0123456789 12 3 . ,,, ... !!!", "a" * 300, "=" * 130 + " " * 70 + "=", "\x00\x01 a \x1c b \x1f c", "don't \x0b stop \x0c now",
    "é combining", "​ zero ﻿ width", "ŉ ﬁ ligature", "a \n b\n \nc  \n", "ÀÉ Ñ ß­­ x",
]


def test_odd_texts_repeats_ties_and_clashing_columns(spark, tools):
    docs = list(enumerate(ODD)) + [(3, "the cat"), (3, "the cat"), (None, "the dog"), (900, "the cat sat")]
    want = brute(tools, docs)
    assert got(spark, docs) == want
    for few in (0, 1, 40):  # the pairs beyond those that are broadcast
        assert got(spark, docs, kept=few) == want
    wide = [(*d, "x", 1, 2, [1]) for d in docs]
    assert got(spark, wide, "doc_id long, text string, a_ids string, row int, pair int, ends array<int>") == want
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_words_apart_are_the_whole_text(tools):
    rng = random.Random(5)
    letters = list("ab é'sß.,-1  \n\t\r") + [" ", " ", "\u0085", "　", "日", "🙂", "…", "à", "th", "ing", "  ", "▁", "\x1c", "\x0b", " ", "©", " ", "ꀠ", "x  "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    tokens = alignment.Tokens(tokenizer_path(alignment.BYTES), tokenizer_path(alignment.PIECES))
    found = []
    for places, sides in tokens(pa.array(texts)):
        words = [*zip(*(x.to_pylist() for x in sides))]
        for own in places.to_pylist():
            ids, ends, at = ([], []), ([], []), 0
            for w in own:
                for k in (0, 1):
                    ids[k].extend(words[w][2 * k])
                    ends[k].extend(at + e for e in words[w][2 * k + 1])
                assert words[w][1][-1] == words[w][3][-1]
                at += words[w][1][-1]
            found.append((ids, ends))
    for (ids, ends), t in zip(found, texts, strict=True):
        a, b = both(tools, t)
        assert (ids, ends) == (([x[0] for x in a], [x[0] for x in b]), ([x[2] for x in a], [x[2] for x in b])), repr(t)


def test_a_very_long_text_is_one_pass(spark, tools):
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta", "naïve", "running", "12345", "x.y"]) for _ in range(60000))
    (row,) = got(spark, [(1, text)])
    a, b = tools[0].encode(" " + text, add_special_tokens=False).ids, tools[1].encode(text)
    assert row[1:3] == (len(a), len(b)) and row[4] == row[1] + row[2] - row[3]


def test_query_matches_brute_force(spark, sf, tools):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = [(i, t if len(t) < 1500 else t[:1500]) for i, t in docs]
    assert got(spark, short) == brute(tools, short)
    whole = {r.doc_id: r for r in alignment.op12_alignment(spark, sf).collect()}
    assert len(whole) == len(docs)
    for i, t in docs:
        a, b = both(tools, t)
        assert (whole[i].n_a, whole[i].n_b, whole[i].n_groups) == (len(a), len(b), len({x[2] for x in a} & {y[2] for y in b}))


def test_links_are_made_in_arrays_with_no_lambda_for_each_word(spark, tools):
    plans = []

    class Seen(Work):
        def save(self, df, name="t"):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().save(df, name)

    rng = random.Random(9)
    parts = ["naïve", "日本", "ing", "ß", "'s", "un", "X", "9", "…", "th", "🙂"]
    docs = [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(40))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = sorted((tuple(r) for r in alignment.align(df, Seen(spark, "test")).select(COLUMNS).collect()), key=repr)
    assert rows == brute(tools, docs)
    assert plans and not any("lambda" in p for p in plans)
