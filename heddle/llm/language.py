"""Language of a text by error-correcting output codes.

Every language has a codeword, and for every bit of it a binary classifier tells the languages whose bit is set from the
others: the log odds of hashed byte runs (two to four bytes of the lower-cased letters of a word with its ends), from
counts over all documents that may be learned from. A text's bits are the mean log odds of its runs; its language is the
one whose codeword has the least loss, each bit weighted by how well it tells that language on those documents. The score
is the nearest codeword's share of exp(-loss); where the second one is close, the text is flagged as ambiguous.

Both passes over the texts to learn from add up in Spark, a number for each language and BUCKET or bit; the driver gets those
sums. The bound is on languages: the MOST that most documents have (equal ones in order of their code points).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import remainder
from .words import encoded, portions, spread
from .work import table
from .worker import trimmed

MOST = 128
BITS = 16
BUCKETS = 1 << BITS
RUNS = (2, 3, 4)
#: Added to every count; runs that are looked at for certainty; the share below which a text is ambiguous.
PRIOR, SURE, AMBIGUOUS = 0.5, 400, 0.75
UNKNOWN = "und"
#: Numbers that are gathered at a time.
TILE = 1 << 22

_MIX = np.uint32(0x9E3779B1)
#: Letters of ASCII and the bytes of all other characters stay, the rest parts words.
_LETTER = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def codewords(n: int, seed: int = 13) -> np.ndarray:
    """A row of 1 and -1 for each of n languages: every way to part them for up to seven, else the best of some random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        ways = np.arange((1 << (n - 1)) - 1)  # the first language's bit is always set; never all are
        rest = np.where((ways[None, :] >> np.arange(n - 1)[:, None]) & 1, 1.0, -1.0)
        return np.concatenate([np.ones((1, len(ways))), rest])
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (n, width))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = (width - code @ code.T) / 2 + width * np.eye(n)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


class Runs:
    """The byte runs of a portion's different words, as buckets."""

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        low = pa.concat_arrays([low, low[:0]])
        _, offsets, data = low.buffers()
        letters = pa.py_buffer(_LETTER[np.frombuffer(data, np.uint8)].tobytes()) if data is not None and data.size else pa.py_buffer(b"")
        clean = pa.Array.from_buffers(pa.large_binary(), len(low), [None, offsets, letters], offset=low.offset)
        self.codes, self.sizes, words = encoded(clean.cast(pa.large_string(), safe=False))
        text = b" ".join([b"", *words.cast(pa.large_binary()).to_pylist(), b""])
        t = np.frombuffer(text, np.uint8)
        blank = t == 32
        at = np.flatnonzero(blank)[:-1] if len(words) else np.empty(0, np.int64)
        found, place = [], []
        for n in RUNS:
            if len(t) < n:
                continue
            m = len(t) - n + 1
            key = np.zeros(m, np.uint32)
            for i in range(n):
                key = (key << np.uint32(8)) | t[i : i + m]
            good = np.ones(m, bool) if n > 2 else ~(blank[:m] & blank[1:])
            for i in range(1, n - 1):  # within a word or at its ends
                good &= ~blank[i : i + m]
            h = (key ^ (key >> np.uint32(15)) ^ np.uint32(n * 0x01000193)) * _MIX >> np.uint32(32 - BITS)
            pos = np.flatnonzero(good)
            found.append(h[pos])
            place.append(np.searchsorted(at, pos, side="right") - 1)
        if found:
            word = np.concatenate(place)
            order = np.argsort(word, kind="stable")
            self.buckets, word = np.concatenate(found)[order].astype(np.int64), word[order]
        else:
            self.buckets, word = np.empty(0, np.int64), np.empty(0, np.int64)
        self.number = np.bincount(word, minlength=len(words)).astype(np.int64)  # runs of each word
        self.first = np.cumsum(self.number) - self.number


class Model:
    """langs in order of their code points, codewords, the log odds of buckets by bit, and the weight of bits by language."""

    def __init__(self, langs: list[str], code: np.ndarray, odds: np.ndarray, weight: np.ndarray | None = None):
        self.langs, self.code, self.odds, self.name = langs, code, odds, uuid.uuid4().hex
        self.weight = np.ones(code.shape) if weight is None else weight

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's mean log odds by bit, and its number of runs."""
        r, width = Runs(texts), self.odds.shape[1]
        words = np.zeros((len(r.number), width), np.float64)
        step = max(1, TILE // width)
        done = 0
        while done < len(r.number):  # whole words at a time
            upto = max(done + 1, int(np.searchsorted(r.first, r.first[done] + step, side="left")))
            a, b = r.first[done], r.first[upto - 1] + r.number[upto - 1]
            words[done:upto] = np.add.reduceat(self.odds[r.buckets[a:b]], r.first[done:upto] - a, axis=0)
            done = upto
        total, n = np.zeros((len(r.sizes), width)), np.zeros(len(r.sizes))
        some = np.flatnonzero(r.sizes > 0)
        if len(some):
            starts = np.cumsum(r.sizes) - r.sizes
            n[some] = np.add.reduceat(r.number[r.codes], starts[some])
            for b in range(width):
                total[some, b] = np.add.reduceat(words[r.codes, b], starts[some])
        return total / np.maximum(n, 1)[:, None], n

    def losses(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each text and language."""
        z = mean * np.sqrt(np.minimum(n, SURE))[:, None]
        out = np.zeros((len(z), len(self.langs)))
        for c in range(len(self.langs)):
            out[:, c] = (self.weight[c] * np.logaddexp(0, -self.code[c] * z)).sum(axis=1)
        return out

    def predict(self, texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Language, score and whether it is ambiguous, for portions of the texts in order."""
        for begin, end in portions(texts):
            own = texts[begin:end]
            lettered = np.asarray(pc.fill_null(pc.match_substring_regex(own, r"\p{L}"), False))
            if not self.langs:
                yield [UNKNOWN] * len(own), np.zeros(len(own)), np.ones(len(own), bool)
                continue
            loss = self.losses(*self.bits(own))
            best = loss.argmin(axis=1)
            share = np.exp(loss.min(axis=1)[:, None] - loss)
            score = np.where(lettered, 1 / share.sum(axis=1), 0.0)
            yield [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered)], score, score < AMBIGUOUS


def _lists(docs: DataFrame) -> DataFrame:
    """lang, buckets, counts: sums over the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            langs = sorted(total)
            at = [np.flatnonzero(total[x]) for x in langs]
            cols = [pa.array(langs, pa.string()), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([total[x][a] for x, a in zip(langs, at)], pa.list_(pa.int64()))]
            total.clear()
            return pa.RecordBatch.from_arrays(cols, ["lang", "buckets", "counts"])

        for b in trimmed(batches):
            lang = b.column(0).dictionary_encode()
            own, names = np.asarray(lang.indices, np.int64), lang.dictionary.to_pylist()
            for begin, end in portions(b.column(1)):
                r = Runs(b.column(1)[begin:end])
                of = np.repeat(own[begin:end], r.sizes)  # the language of every word in order
                pair, n = np.unique(of * max(1, len(r.number)) + r.codes, return_counts=True)
                at, word = pair // max(1, len(r.number)), pair % max(1, len(r.number))
                for k in np.unique(at).tolist():
                    mine = at == k
                    w = word[mine]
                    found = np.bincount(spread(r.buckets, r.first[w], r.number[w]), np.repeat(n[mine], r.number[w]), BUCKETS)
                    held = total.setdefault(names[k], np.zeros(BUCKETS, np.int64))
                    held += found.astype(np.int64)
            if len(total) > 64:
                yield given()
        yield given()

    return docs.select("lang", "text").mapInArrow(run, "lang string, buckets array<int>, counts array<long>")


def odds_of(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log odds by bucket and bit: the mean shares of the languages whose bit is set against those of the others."""
    share = (counts + PRIOR) / (counts.sum(axis=1) + PRIOR * counts.shape[1])[:, None]
    out = np.zeros((counts.shape[1], code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        yes, no = code[:, b] > 0, code[:, b] < 0
        if yes.any() and no.any():
            out[:, b] = np.log(share[yes].mean(axis=0)) - np.log(share[no].mean(axis=0))
    return out


def _hits(docs: DataFrame, held) -> DataFrame:
    """lang, n, hits by bit: of how many texts the bit was right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        place = {x: i for i, x in enumerate(model.langs)}
        n, hits = np.zeros(len(place), np.int64), np.zeros(model.code.shape, np.int64)
        for b in trimmed(batches):
            for begin, end in portions(b.column(1)):
                own = np.array([place.get(x, -1) for x in b.column(0)[begin:end].to_pylist()], np.int64)
                mean, runs = model.bits(b.column(1)[begin:end])
                good = (own >= 0) & (runs > 0)
                np.add.at(n, own[good], 1)
                np.add.at(hits, own[good], mean[good] * model.code[own[good]] > 0)
        rows = [(x, b, int(n[i]), int(hits[i, b])) for i, x in enumerate(model.langs) for b in range(hits.shape[1]) if n[i]]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["lang", "bit", "n", "hits"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bit int, n long, hits long")


def fit(docs: DataFrame) -> Model:
    """A model of a table (lang, text), from all its rows whose lang is among the MOST commonest. Null languages and texts
    teach nothing; without any text with letters the model knows no language."""
    docs = docs.where("lang is not null and text is not null")
    common = [r["lang"] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST).collect()]
    if not common:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32))
    docs = docs.where(F.col("lang").isin(common))
    found = _lists(docs).select("lang", F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("lang", F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    counts[[place[x] for x in found.column("lang").to_pylist()], np.asarray(found.column("bucket"))] = np.asarray(found.column("n"))
    code = codewords(len(langs))
    model = Model(langs, code, odds_of(counts, code))
    if len(langs) > 1:
        held = docs.sparkSession.sparkContext.broadcast(model)
        right = np.full(code.shape, 0.5)
        for r in _hits(docs, held).groupBy("lang", "bit").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect():
            right[place[r["lang"]], r["bit"]] = (r["hits"] + 0.5) / (r["n"] + 1)
        held.destroy()
        good = np.maximum(2 * right - 1, 1e-3)  # how far above chance
        model = Model(langs, code, model.odds, good / good.sum(axis=1, keepdims=True) * code.shape[1])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """id, lang_pred, score, ambiguous for every row of id, text. A null text, or one without a letter, is `und` with score 0
    and ambiguous, and so is every text if nothing was learned. Repeated rows are told each; an empty table gives an empty
    one."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in trimmed(batches):
            got = [*model.predict(b.column(1))]
            lang = pa.array([x for g in got for x in g[0]], pa.string())
            score, flag = (np.concatenate([*(g[k] for g in got), np.empty(0, kind)]) for k, kind in ((1, float), (2, bool)))
            yield pa.RecordBatch.from_arrays([b.column(0), lang, pa.array(score, pa.float64()), pa.array(flag, pa.bool_())], ["id", "lang_pred", "score", "ambiguous"])

    return docs.select("id", "text").mapInArrow(run, "id long, lang_pred string, score double, ambiguous boolean")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(docs.where(remainder("id", 4) != 2))
    out = predict(docs, model)
    return out.select(F.col("id").alias("doc_id"), (remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
