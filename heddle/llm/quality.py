"""Quality by supervised subword embeddings.

A document's features are its words, pairs of neighbouring words (a word after itself is one feature of its own,
whatever the word) and the three to five letter runs of each word with its ends marked, all hashed into BUCKETS rows of
a learned table. Their mean goes through a softmax; table and softmax are trained by numpy stochastic gradient descent
on a bounded sample (at most ZEROS and ONES labelled documents), weighted to the class shares of all labels. Both maps
are linear, so scoring needs one number for each bucket, and a worker keeps the sums of words that it has seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .words import encoded, portions, sums
from .work import Work, table
from .worker import kept, Memo, trimmed

ZEROS, ONES = 1000, 2000
BITS, WIDTH, EPOCHS, RATE, SEED = 17, 8, 5, 0.5, 11
BUCKETS = 1 << BITS
AGAIN = 0x9E3779B97F4A7C15
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)


def pieces(word: str) -> list[int]:
    """Buckets of a word and of its letter runs."""
    digest, mask = xxhash.xxh32_intdigest, BUCKETS - 1
    marked = f"<{word}>".encode("utf-8", "surrogatepass") if word.isascii() else f"<{word}>"
    if isinstance(marked, bytes):
        runs = {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    else:
        runs = {marked[i : i + n].encode("utf-8", "surrogatepass") for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
        marked = marked.encode("utf-8", "surrogatepass")
    return [digest(marked, 1) & mask, *(digest(r, 2) & mask for r in runs)]


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words."""
    a, b = hashes[:-1], hashes[1:]
    key = np.where(a == b, np.uint64(AGAIN), a * _A + b) * _B
    return (key ^ (key >> np.uint64(29))) * _A >> _SHIFT


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their counts."""
    words = [w.decode("utf-8", "replace") for w in text.encode("utf-8", "surrogatepass").split()]
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    seen: dict[str, list[int]] = {}
    found: list[int] = []
    for w in words:
        if w not in seen:
            seen[w] = pieces(w)
        found += seen[w]
    h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    at, n = np.unique(np.concatenate([np.array(found, np.uint64), pairs(h)]), return_counts=True)
    return at.astype(np.uint32), n.astype(np.uint32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int, float]], seed: int = SEED) -> tuple[np.ndarray, float]:
    """rows: buckets, counts, label, weight. Returns each bucket's log odds, and the offset."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    rows = [(a, (n / n.sum()).astype(np.float32), y, w) for a, n, y, w in rows if len(a)]
    steps = max(1, EPOCHS * len(rows))
    for step, i in enumerate(np.concatenate([rng.permutation(len(rows)) for _ in range(EPOCHS)]) if rows else []):
        at, share, y, weight = rows[i]
        rate = RATE * (1 - step / steps)
        hidden = share @ table[at]
        logit = hidden @ out + bias
        p = np.exp(logit - logit.max())
        p /= p.sum()
        p[y] -= 1
        p *= np.float32(rate * weight)
        back = out @ p
        out -= np.outer(hidden, p)
        bias -= p
        # the mean's gradient, shared out by count and scaled up, as each bucket is in few documents
        table[at] -= np.minimum(share * len(at), 10)[:, None] * back
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


class Model:
    def __init__(self, odds: np.ndarray, offset: float):
        self.odds, self.offset, self.name = odds, offset, uuid.uuid4().hex

    def _word(self, word: bytes) -> tuple[float, int, int]:
        """Sum and number of a word's own buckets, and its hash."""
        own = pieces(word.decode("utf-8", "replace"))
        return float(self.odds[own].sum()), len(own), xxhash.xxh64_intdigest(word)

    def scores(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Scores of portions of the texts, in order; null counts as empty."""
        memo = kept("quality", self.name, Memo)
        for begin, end in portions(texts):
            codes, sizes, words = encoded(texts[begin:end])
            words = words.cast(pa.large_binary()).to_pylist()
            new = {w: self._word(w) for w in words if w not in memo}
            memo.learn(new)
            held = [memo[w] if w in memo else new[w] for w in words]
            own, n = (np.array([h[k] for h in held], np.float64) for k in (0, 1))
            h = np.array([h[2] for h in held], np.uint64)[codes]
            last = np.cumsum(sizes)[sizes > 0] - 1  # a pair doesn't reach over the end of a text
            two = np.append(self.odds[pairs(h).astype(np.int64)], 0.0)[: len(h)]
            two[last] = 0
            total = sums(own[codes] + two, sizes)
            count = sums(n[codes], sizes) + np.maximum(sizes - 1, 0)
            yield 1 / (1 + np.exp(-np.clip(self.offset + total / np.maximum(count, 1), -30, 30)))

    def score(self, text: str) -> float:
        return float(next(self.scores(pa.array([text])))[0])


def fit(docs: DataFrame, labels: DataFrame, work: Work, label: str = "quality", mod: int = 5, out: int = 0) -> Model:
    """Trains on the driver, which gets the buckets of the ZEROS + ONES texts: 8 bytes for each of a text's different features."""
    texts, zeros, ones = sample(work, docs, labels, label, ZEROS, ONES, mod, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            got = [features(x.as_py() or "") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], ["id", "y", "at", "n"])

    found = texts.select("id", "y", "text").mapInArrow(run, "id long, y int, at binary, n binary").collect()
    found.sort(key=lambda r: r["id"])
    n = [max(1, sum(r["y"] == c for r in found)) for c in (0, 1)]
    weight = [s / m * len(found) / max(1, zeros + ones) for s, m in zip((zeros, ones), n)]
    return Model(*train([(np.frombuffer(r["at"], np.uint32), np.frombuffer(r["n"], np.uint32), r["y"], weight[r["y"]]) for r in found]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """id, score for every row of id, text; null and empty texts get the offset's score (0.5 without labels). Repeated rows
    are scored each; an empty table gives an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in trimmed(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([*model.scores(b.column(1)), np.empty(0)]))], ["id", "score"])

    return docs.mapInArrow(run, "id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, Work(spark, "quality"))
    out = score(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), model)
    return out.select(F.col("id").alias("doc_id"), (remainder("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
