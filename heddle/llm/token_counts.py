"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; for every end the best score and its number of
pieces are carried, and no path is kept. Ties follow the exact rule of the tokenizers library: of equal scores the
candidate that starts first stays. A character that no piece covers alone scores ten below the least piece and counts
as one piece for each UTF-8 byte (byte fallback).

Text is split at white space, and each word gets the mark U+2581 in front, so words are independent and a worker keeps
the counts of words that it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import tokenizer_path
from .words import encoded, portions, sums
from .work import table
from .worker import kept, Memo, trimmed

MODEL = "piece_bpe_32k.model"
MARK = "▁"
PENALTY = 10.0
NORMAL = 1


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message: number and value."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = {1: (8, at), 5: (4, at)}[tag & 7] if tag & 7 in (1, 5) else varint(at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model file with their scores, in its order."""
    found = []
    with open(path, "rb") as f:
        raw = f.read()
    for number, message in _fields(raw):
        if number == 1:
            piece = dict(_fields(message))
            if piece.get(3, NORMAL) == NORMAL:
                found.append((piece[1].decode(), float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0))
    return found


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.kept = Memo()

    def word(self, word: str) -> int:
        marked = MARK + word
        n = len(marked)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # ends up to here are final

        def close(upto: int, at: int, best: float | None, pieces: int, alone: bool) -> int:
            """Makes the ends after `at` final, up to `upto`; best, pieces and alone tell of end at + 1."""
            while at < upto:
                if not alone:
                    other = score[at] + self.unknown
                    if best is None or other > best:
                        best, pieces = other, count[at] + len(marked[at].encode("utf-8", "surrogatepass"))
                at += 1
                score[at], count[at] = best, pieces
                best, pieces, alone = None, 0, False
            return at

        best, pieces, alone = None, 0, False
        for last, (size, value) in self.automaton.iter(marked):  # of one end, the longest first
            if last > done:
                done = close(last, done, best, pieces, alone)
                best, pieces, alone = None, 0, False
            start = last + 1 - size
            other = score[start] + value
            if best is None or other > best:
                best, pieces = other, count[start] + 1
            alone |= size == 1
        close(n, done, best, pieces, alone)
        return count[n]

    def counts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Counts of portions of the texts, in order; null counts as empty."""
        kept = self.kept
        for begin, end in portions(texts):
            codes, sizes, words = encoded(texts[begin:end])
            words = words.to_pylist()
            new = {w: self.word(w) for w in words if w not in kept}
            kept.learn(new)
            own = np.array([kept[w] if w in kept else new[w] for w in words], np.float64)
            yield sums(own[codes], sizes).astype(np.int64)

    def __call__(self, text: str) -> int:
        return int(next(self.counts(pa.array([text])))[0])


def counter(path: str) -> Counter:
    return kept("token counts", path, lambda: Counter(vocabulary(path)))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document. Null and empty texts have 0; repeated rows are counted each; the table may be
    empty; other columns aren't read."""
    path = path or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in trimmed(batches):
            n = np.concatenate([*count.counts(b.column(1)), np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
