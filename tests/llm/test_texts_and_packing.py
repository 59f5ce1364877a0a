import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from heddle.llm import mixing, packing, spans, token_counts, toxicity
from heddle.llm.work import Work, ranked

from . import brute
from .test_near import exact

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def dedup(spark, rows, **kw):
    d = spark.createDataFrame(list(rows), "id long, text string").repartition(3)
    return {r.id: r.text for r in spans.dedup(d, Work(spark, "test"), **kw).collect()}


def passage(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def test_spans_match_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    long = passage(60, 1)
    docs += [(1000 + i, f"{passage(20, 10 + i)} {long} {passage(25, 50 + i)}") for i in range(8)]
    docs += [(2000, long + "\n" + long), (2001, passage(55, 2).replace(".", "")), (2002, passage(9, 3) + " " + passage(55, 2).replace(".", "") + " end")]
    assert dedup(spark, docs) == brute.spans(docs)


def test_spans_catch_long_passages_and_leave_others(spark):
    shared, plain = passage(70, 4), passage(70, 5).replace(".", "")
    docs = [(i, f"{passage(30, 100 + i)} {shared if i % 2 else plain} {passage(30, 200 + i)}") for i in range(12)]
    docs += [(50, "Short. Short. Of the. " + passage(40, 7)), (51, "Short. Short. Of the. " + passage(40, 8))]
    got = dedup(spark, docs)
    assert got[0] == docs[0][1] and got[1] == docs[1][1] and got[50] == docs[12][1] and got[51] == docs[13][1]
    for i in range(2, 12):
        words = (shared if i % 2 else plain).split()
        kept = sum(" ".join(words[j : j + 8]) in got[i] for j in range(len(words) - 7))
        assert kept <= 0.4 * len(words)
        assert got[i].startswith(passage(20, 100 + i)[:80])


def test_spans_of_stutters_and_of_the_ends_of_repeats(spark):
    words = passage(60, 21).replace(".", "").split()
    sizes = [10, 10, 10, 10, 5]  # the spans onwards from the last sentences reach beyond the passage
    ends = np.cumsum(sizes)
    repeated = " ".join(" ".join(words[e - s : e]) + "." for s, e in zip(sizes, ends))
    docs = [(i, f"{passage(18, 300 + i)} {repeated} {passage(27, 400 + i)}") for i in range(5)]
    docs += [(20, "und. " * 60 + passage(30, 9)), (21, f"{repeated[:1]}{passage(90, 8)} {passage(30, 7)} {passage(90, 8)}")]
    got = dedup(spark, docs)
    assert got == brute.spans(docs)
    assert got[0] == docs[0][1] and not any(part in got[i] for i in range(1, 5) for part in repeated[:-1].split(". "))
    assert got[20].count("und. ") < 35 and got[20].endswith(passage(30, 9)) and passage(30, 7)[:40] in got[21] and len(got[21]) < 0.7 * len(docs[6][1])


def test_spans_that_follow_at_once_go(spark):
    two = "one two three four five six seven eight. nine ten eleven twelve thirteen fourteen fifteen sixteen. "
    line = "the same line of seven words here\n"
    docs = [(1, two * 2), (2, line * 20), (3, two.upper().replace(" ", "  ") * 6), (4, "a b c. d e f. g. a b c. d e f."), (5, "d e f. g. x. y")]
    got = dedup(spark, docs)
    assert got == brute.spans(docs)
    assert got[1] == two.rstrip() and got[2] == line * 3 and got[3] == "" and got[4] == docs[3][1]
    short = dedup(spark, docs, least=1)
    assert short == brute.spans(docs, least=1)
    assert short[4] == "a b c. d e f. g." and short[5] == " x. y" and short[2] == line * 2


def test_spans_keep_further_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "x", 7, "c", 0.5), (2, "y", 8, "d", 1.5)], "id long, text string, removed int, cuts string, gone double")
    out = spans.dedup(d, Work(spark, "test"))
    assert out.columns == ["id", "text", "removed_", "cuts_", "removed", "cuts", "gone"]
    assert sorted((r.id, r.removed, r.cuts, r.gone, r.removed_) for r in out.collect()) == [(1, 7, "c", 0.5, 0), (2, 8, "d", 1.5, 0)]


def test_spans_edges(spark):
    same = passage(40, 9)
    got = spans.dedup(spark.createDataFrame([(1, None, 7), (2, "", 8), (3, " \n ", 9), (4, same, 1), (4, same, 2), (5, same, 3), (None, same, 4)], "id long, text string, gone int"), Work(spark, "test")).collect()
    assert sorted((r.id or 0, r.gone, r.text) for r in got) == sorted([(1, 7, None), (2, 8, ""), (3, 9, " \n "), (4, 1, same), (4, 2, same), (5, 3, ""), (0, 4, same)], key=lambda x: (x[0], x[1]))
    assert spans.dedup(spark.createDataFrame([], "id long, text string"), Work(spark, "test")).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .!?\n\tü", max_size=200))
def test_sentences_are_the_whole_text(text):
    parts, sizes, hashes = spans.sentences(text)
    assert "".join(parts) == text and sum(sizes) == len(text.split()) and len(hashes) == 8 * len(parts) == 8 * len(sizes)
    for first, end, _ in spans.onwards(sizes, hashes) + spans.backwards(sizes, hashes):
        assert end - first >= 2 and sum(sizes[first:end]) >= spans.LEAST


def test_mixing_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.integers(0, 40)), ["b", "a", "Z", "é", None, "c"][int(rng.choice(6, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]))]) for i in range(600)]
    d = docs_of(spark, [(i, None if n == 0 and i % 2 else "w " * n, s) for i, n, s in rows]).repartition(5)
    copies, target, size = brute.mixing([(i, s, n) for i, n, s in rows])
    got = {r.doc_id: r for r in mixing.copies(d).collect()}
    assert {i: r.copies for i, r in got.items()} == copies
    for i, n, s in rows:
        assert got[i].size == n and got[i].source_size == size[s] and abs(got[i].target - target[s]) < 1e-6 * max(1, target[s]) and got[i].copies <= 3
    for s in size:
        taken = sum(r.copies * r.size for r in got.values() if r.source == s)
        assert abs(taken - target[s]) <= 2 * max(n for _, n, t in rows if t == s)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6


def test_mixing_edges(spark):
    assert mixing.copies(docs_of(spark, [(1, "a", "s")]).limit(0)).collect() == []
    got = mixing.copies(docs_of(spark, [(1, None, "s"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.copies) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    same = mixing.copies(docs_of(spark, [(None, "a b", "s"), (1, "a b", "s"), (1, "a b", "s")])).collect()
    assert sum(r.copies for r in same) == 3


def test_ranks_are_those_of_one_sort(spark):
    rng = np.random.default_rng(4)
    rows = [(None if x == 9 else int(x), None if y == 30 else int(y), i) for i, (x, y) in enumerate(zip(rng.choice(10, 500, p=[0.55] + [0.05] * 9), rng.integers(0, 31, 500)))]
    got = ranked(Work(spark, "test"), spark.createDataFrame(rows, "g int, o int, i int").repartition(6), ["g"], ["o", "i"], "place").collect()
    last = float("inf")
    for g in {x for x, _, _ in rows}:
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (last if r[1] is None else r[1], r[2]))
        assert [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == [r[2] for r in want]
        assert sorted(r.place for r in got if r.g == g) == list(range(1, len(want) + 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plans_are_valid_and_near_the_bound(sizes):
    plan = packing.Plan(dict(Counter(sizes)), 40)
    keys, per, first, offset = plan.arrays()
    used = defaultdict(list)
    for s, n in Counter(sizes).items():
        for rank in range(n):
            key = (s << 40) + rank
            at = np.searchsorted(keys, key, side="right") - 1
            i = key - keys[at]
            used[int(first[at] + i // per[at])].append((int(offset[at] + i % per[at] * s), s))
    for places in used.values():
        end = 0
        for at, s in sorted(places):
            assert at == end
            end += s
        assert end <= 40
    rooms = []  # best fit alone
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 40) - s)
    assert len(used) == plan.bins <= len(rooms) + 1


def test_packing_holds_the_tokenizer_ids(spark, sf):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts |= {9000: "", 9001: None, 9002: "<|endoftext|> a <|startoftext|>", 9003: "don't I'LL \x85 　 ΣΑΣ é İ it's '", 9004: "word " * 9000, 9005: "x" * 5000}
    rows = packing.pack_documents(docs_of(spark, [(i, t, "s") for i, t in texts.items()]).repartition(3)).collect()
    by, used = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 4096)))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == 4096 * r.piece and r.length == min(4096, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())
    for places in used.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 4096
    assert len(used) <= -(-total // 4096) + 2


def test_packing_edges(spark):
    assert packing.pack_documents(docs_of(spark, [(1, "a", "s")]).limit(0)).collect() == []
    rows = packing.pack_documents(docs_of(spark, [(None, "a", "s"), (1, "a", "s"), (1, "a", "s")])).collect()
    assert len(rows) == 3 and {r.length for r in rows} == {2} and sorted(r.offset for r in rows) == [0, 2, 4]


def test_token_counts_are_those_of_the_library(spark, sf):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary(packing.tokenizer_path(token_counts.MODEL))
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", -1e9) for i in range(256))], unk_id=0, byte_fallback=True))
    model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[\\x20\\x09-\\x0D]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always")])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts |= {9000: "", 9001: None, 9002: "日本語 ꙮꙮ \U0001f600x", 9003: "a" * 3000, 9004: " \t\n", 9005: "x\vy\fz\r\nw"}
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_of(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == {i: len(model.encode(t or "").ids) for i, t in texts.items()}
    assert token_counts.token_counts(docs_of(spark, []).limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc", min_size=1, max_size=4), st.integers(-9, 0)), min_size=1, max_size=12, unique_by=lambda x: x[0]), st.text(alphabet="abcd", max_size=12))
def test_viterbi_ties_are_those_of_the_library(pieces, word):
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), (token_counts.MARK, -1.0), *((p, float(s)) for p, s in pieces)]
    model = Tokenizer(models.Unigram([*pieces, *((f"<0x{i:02X}>", 0.0) for i in range(256))], unk_id=0, byte_fallback=True))
    assert token_counts.Counter(pieces[1:]).word(word) == len(model.encode(token_counts.MARK + word).ids)


def test_pipeline_matches_brute_force(spark, sf):
    """Each stage against a plain version over the rows that the stage before left."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    work = Work(spark, "test")
    index = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), Work(spark, "test"))
    rows = lambda d: {r.doc_id: r for r in d.collect()}
    before, step = rows(docs), docs
    for name, stage in corpus_pipeline.STAGES:
        step = work.save(stage(spark, step, sf), name)
        if name == "packing":
            break
        assert step.columns == docs.columns
        if name == "toxicity":
            scores = index.scores(pa.array([r.text for r in before.values()]))
            want = {i: r for (i, r), (p, _) in zip(before.items(), scores) if p < 0.5}
        elif name == "simhash":
            first = exact({i: r.text for i, r in before.items()})
            want = {i: r for i, r in before.items() if i in first}
        elif name == "spans":
            texts = brute.spans([(i, r.text) for i, r in before.items()])
            assert {r.doc_id: (r.text, r.n_chars) for r in step.collect()} == {i: (t, len(t)) for i, t in texts.items()}
            before = rows(step)
            continue
        elif name == "mixing":
            copies, _, _ = brute.mixing([(i, r.source, len(brute.word_list(r.text))) for i, r in before.items()])
            assert Counter(r.doc_id for r in step.collect()) == Counter({i: n for i, n in copies.items() if n})
            mixed = step
            continue
        assert rows(step) == want
        before = want
    packed = step.collect()
    assert sum(r.piece == 0 for r in packed) == mixed.count()
    run = corpus_pipeline.run(spark, sf)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run.collect())) == sorted(map(key, packed))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_with_nulls_repeats_and_clashing_columns(spark, sf, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, times int, gone int, size int, id string, __pid int, removed int, cuts string, place int, none int"
    rows = [(1, "a b c", "en", "s", 5, 1, 2, 3, 4, "x"), (1, "a b c", "en", "s", 5, 1, 2, 3, 4, "x"), (None,) * 10, (2, "", "en", None, 0, 0, 0, 0, 0, ""), (3, "w " * 3000, "en", "t", 6000, 1, 1, 1, 1, "y")]
    rows = [(*r, 77 + i, 5, "cut", 6, 7) for i, r in enumerate(rows)]
    d = spark.createDataFrame(rows, schema)
    out = stage(spark, d, sf)
    assert out.columns == d.columns and out.count() <= 3 * len(rows)
    known = {r[10]: r for r in rows}
    for r in out.collect():  # other columns come back as they were
        assert tuple(r)[5:] == known[r["__pid"]][5:] and r.doc_id == known[r["__pid"]][0]
    assert stage(spark, d.limit(0), sf).collect() == []
