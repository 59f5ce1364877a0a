"""Toxicity by the nearest labelled examples.

A bounded sample of labelled documents (at most POSITIVE and NEGATIVE) is indexed whole. Terms are words and the
beginnings of words; every term of the sample counts. A weight is (1 + ln n) x idf x relevance:
document frequencies are those of all documents, and the relevance is a soft threshold on how many standard errors the
term's log odds ratio of the labels lies from zero, so no term's is zero. Vectors are scaled to length one.

The index is inverted: postings by term and block of examples, and each term's largest weight in each block, for the
heaviest terms; of the many light ones examples and blocks hold their length. A query's upper bound for a block is the
sum of its weights times the largest ones, and of the light lengths' product. Blocks are opened in order of their
bounds, until no bound reaches the k-th best score, and examples whose own bound reaches it get their light terms added
one by one, so the k nearest by cosine over all terms are exact. They vote with the fourth power of their
cosine, scaled from the sample's class shares to those of all labels, and a logistic fitted on the examples (each left
out in turn) calibrates the vote. The nearest examples are returned as evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .words import encoded, portions, spread, sums
from .work import Work, table
from .worker import only, trimmed

POSITIVE, NEGATIVE = 1000, 1000
#: Standard errors at which a term's relevance sets in, and how steeply.
SETS_IN, STEEP = 3.0, 4.0
NEIGHBOURS, POWER, SMOOTH, BLOCK = 15, 4, 0.05, 64
#: Terms, the first in order of weight, that are looked up in postings; the others' part is bounded and added where the
#: bound leaves an example in the running. And what bounds have above their sums, for rounding.
HEAVY, SLACK = 16_384, 1e-9
EDGE = ".,;:!?*%&$#\"'()[]"


def terms_of(words: pa.Array) -> list[pa.Array]:
    """Of each lower-case word: itself without punctuation at its ends, and the first four and five letters of longer
    ones, marked; null where there is none."""
    word = pc.utf8_trim(words, characters=EDGE)
    size = pc.utf8_length(word)
    found = [pc.if_else(pc.greater(size, 0), word, pa.scalar(None, word.type))]
    for n in (4, 5):
        start = pc.binary_join_element_wise(pc.utf8_slice_codeunits(word, 0, n), pa.scalar("~", word.type), pa.scalar("", word.type))
        found.append(pc.if_else(pc.greater(size, n), start, pa.scalar(None, word.type)))
    return found


def counted(texts: pa.Array, terms: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text, term and count of every term of every text, in that order, and the terms, whose places these are: those
    given (others are left out), or all that occur."""
    codes, sizes, words = encoded(pc.utf8_lower(texts.cast(pa.large_string())))
    own = terms_of(words)
    if terms is None:
        terms = pc.unique(pa.concat_arrays(own)).drop_null()
    places = np.stack([np.asarray(pc.fill_null(pc.index_in(t, value_set=terms), -1), np.int64) for t in own], axis=1)
    per, flat = (places >= 0).sum(axis=1), places[places >= 0]
    many = max(1, len(words))
    some = per[codes] > 0
    key, n = np.unique(np.repeat(np.arange(len(sizes)), sizes)[some] * many + codes[some], return_counts=True)  # once for each word of a text
    doc, code = key // many, key % many
    term = spread(flat, (np.cumsum(per) - per)[code], per[code])
    key, n = np.repeat(doc, per[code]) * max(1, len(terms)) + term, np.repeat(n, per[code])
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.add.reduceat(n[order], first) if len(first) else n
    return key[first] // max(1, len(terms)), key[first] % max(1, len(terms)), n, terms


class Index:
    """Examples by block; exact k nearest by cosine. Equal scores go to the example that comes first."""

    def __init__(self, terms: pa.Array, weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], shares: tuple[float, float]):
        """terms (heaviest first, for speed alone), with a weight for each; examples: id, label, places of their terms (ascending) and
        counts; shares: each class's share of all labels."""
        self.terms, self.weight = terms, weight
        rows = [(i, y, at, self.weights(at, n)) for i, y, at, n in examples if len(at)]
        rows.sort(key=lambda r: (int(r[2][np.argmax(r[3])]), r[0]))  # alike examples share blocks
        self.ids, self.y = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        self.blocks = -(-len(rows) // BLOCK)
        self.begin = np.cumsum([0] + [len(r[2]) for r in rows])
        self.at = np.concatenate([r[2] for r in rows] or [np.empty(0, np.int64)]).astype(np.int64)
        self.own = np.concatenate([r[3] for r in rows] or [np.empty(0)])
        row, heavy = np.repeat(np.arange(len(rows)), np.diff(self.begin)), self.at < HEAVY
        self.split = self.begin[:-1] + np.bincount(row[heavy], minlength=len(rows))  # where an example's light terms begin
        self.rest = np.sqrt(np.bincount(row, weights=np.where(heavy, 0.0, self.own**2), minlength=len(rows)))
        self.most_rest = np.maximum.reduceat(self.rest, np.arange(0, len(rows), BLOCK)) if rows else self.rest
        order = np.flatnonzero(heavy)[np.argsort(self.at[heavy], kind="stable")]  # by term, then example
        self.row, self.value = row[order], self.own[order]
        key, cells = self.at[order] * max(1, self.blocks) + self.row // BLOCK, min(HEAVY, len(terms)) * self.blocks
        self.start = np.searchsorted(key, np.arange(cells + 1)).astype(np.int32)
        most = np.zeros(cells)
        np.maximum.at(most, key, self.value)
        self.most, self.scratch = most.reshape(-1, max(1, self.blocks)), np.zeros(len(terms))
        size = [max(1, sum(y == c for _, y, _, _ in examples)) for c in (0, 1)]
        self.votes = np.where(self.y == 1, shares[1] / size[1], shares[0] / size[0]) * (size[0] + size[1])
        self.prior, self.a, self.b = shares[1], 1.0, 0.0

    def weights(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.weight[at]
        return w / np.linalg.norm(w) if len(w) else w

    def _heavy(self, at: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The heavy terms' part of the cosines with all examples of the blocks; 0 for the others."""
        cell = (at[:, None] * self.blocks + blocks).ravel()
        begin = self.start[cell].astype(np.int64)
        n = self.start[cell + 1] - begin
        spot = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
        return np.bincount(self.row[spot], weights=np.repeat(np.repeat(w, len(blocks)), n) * self.value[spot], minlength=len(self.ids))

    def _light(self, at: np.ndarray, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The light terms' part of the cosines with these examples."""
        begin, q = self.split[rows], self.scratch
        n = self.begin[rows + 1] - begin
        spot = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
        q[at] = w
        part = q[self.at[spot]] * self.own[spot]
        q[at] = 0
        return sums(part, n)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine."""
        h = int(np.searchsorted(at, HEAVY))
        rest = float(np.linalg.norm(w[h:]))
        bound = w[:h] @ self.most[at[:h]] + rest * self.most_rest + SLACK
        order = np.argsort(-bound, kind="stable")
        scores, seen, opened, cutoff = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool), 0, 0.0
        while opened < len(order):
            more = min(len(order), opened + 2)
            if opened:
                cutoff = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
                more = opened + int((bound[order[opened:]] >= cutoff).sum())
                if more == opened:
                    break
            blocks = order[opened:more]
            if h:
                scores += self._heavy(at[:h], w[:h], blocks)
            seen[(blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel().clip(max=len(seen) - 1)] = True
            if skip >= 0:
                scores[skip], seen[skip] = 0, False
            opened = more
        if h < len(at):
            first = np.argpartition(-scores, 2 * k)[: 2 * k] if len(scores) > 2 * k else np.arange(len(scores))
            first = first[seen[first]]
            exact = scores[first] + self._light(at[h:], w[h:], first)
            cutoff = np.partition(exact, -k)[-k] if len(exact) > k else 0.0
            seen[first] = False
            more = np.flatnonzero(seen & (scores + rest * self.rest + SLACK >= cutoff))
            where, exact = np.append(first, more), np.append(exact, scores[more] + self._light(at[h:], w[h:], more))
        else:
            where = np.flatnonzero(seen)
            exact = scores[where]
        where, exact = where[exact > 0], exact[exact > 0]
        best = np.lexsort((where, -exact))[:k]
        return where[best], exact[best]

    def vote(self, at: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray]:
        where, cosine = self.nearest(at, w, skip=skip) if len(at) and len(self.ids) else (np.empty(0, np.int64), np.empty(0))
        v = cosine**POWER * self.votes[where]
        return (float(v @ self.y[where]) + SMOOTH * self.prior) / (float(v.sum()) + SMOOTH), where

    def calibrate(self) -> None:
        """A logistic of the vote's log odds, by Newton steps, with a unit Gaussian around the identity."""
        if not len(self.ids) or not 0 < self.prior < 1:
            return
        own = [slice(a, b) for a, b in zip(self.begin[:-1], self.begin[1:])]
        x = [self.odds(self.vote(self.at[s], self.own[s], skip=i)[0]) for i, s in enumerate(own)]
        x, a = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
        weight = self.votes / self.votes.mean()
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            grad = x.T @ (weight * (p - self.y)) + (a - [1.0, 0.0])
            a = a - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
        if a[0] > 0:
            self.a, self.b = float(a[0]), float(a[1])

    @staticmethod
    def odds(p: float) -> float:
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def scores(self, texts: pa.Array) -> Iterator[tuple[float, list[int]]]:
        """Score and nearest examples of each text; null counts as empty."""
        for begin, end in portions(texts):
            doc, term, n, _ = counted(texts[begin:end], self.terms)
            edge = np.searchsorted(doc, np.arange(end - begin + 1))
            for i in range(end - begin):
                s = slice(edge[i], edge[i + 1])
                p, where = self.vote(term[s], self.weights(term[s], n[s]))
                if not 0 < self.prior < 1:
                    yield self.prior, []
                else:
                    yield 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * self.odds(p) + self.b)))), self.ids[where[:3]].tolist()


def relevance(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """A soft threshold on the log odds ratio of terms that `ones` of n1 and `zeros` of n0 examples have, in standard errors."""
    a, b, c, d = ones + 0.5, zeros + 0.5, n1 - ones + 0.5, n0 - zeros + 0.5
    z = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return np.logaddexp(0.0, STEEP * (z - SETS_IN)) / STEEP


def frequencies(docs: DataFrame, terms: pa.Array) -> tuple[np.ndarray, int]:
    """In how many texts (column text) each term occurs, and how many texts there are. A task hands on one row for each
    of its terms, and as many rows as there are terms reach the driver."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        terms = held.value
        found, n = np.zeros(len(terms), np.int64), 0
        for b in trimmed(batches):
            n += b.num_rows
            for begin, end in portions(b.column(0)):
                found += np.bincount(counted(b.column(0)[begin:end], terms)[1], minlength=len(terms))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[some], n))], ["place", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = (np.asarray(rows.column(c).combine_chunks(), np.int64) for c in ("place", "n"))
    out = np.zeros(len(terms), np.int64)
    out[place[place >= 0]] = n[place >= 0]
    return out, int(n[place < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, work: Work, label: str = "toxic", mod: int = 5, out: int = 0) -> Index:
    """The index of a bounded sample. The terms and counts of its texts (POSITIVE + NEGATIVE of them) reach the driver;
    document frequencies are counted over all docs.

    Null texts count as empty, and examples without terms take no part; repeated documents and labels: see sample().
    Without docs or labels the index is empty.
    """
    texts, zeros, ones = sample(work, docs, labels, label, NEGATIVE, POSITIVE, mod, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for b in trimmed(batches):
            for begin, end in portions(b.column(2)):
                doc, term, n, terms = counted(b.column(2)[begin:end])
                edge = pa.array(np.searchsorted(doc, np.arange(end - begin + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edge, x) for x in (terms.take(pa.array(term)).cast(pa.string()), pa.array(n, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0)[begin:end], b.column(1)[begin:end], *lists], ["id", "y", "terms", "n"])

    rows = texts.select("id", "y", "text").mapInArrow(run, "id long, y int, terms array<string>, n array<long>").toArrow().sort_by("id").combine_chunks()
    ids, y = (rows.column(c).to_pylist() for c in ("id", "y"))
    lists = rows.column("terms").combine_chunks()
    edge, n = np.cumsum([0, *pc.list_value_length(lists).to_pylist()]), np.asarray(rows.column("n").combine_chunks().flatten(), np.float64)
    flat = lists.flatten().cast(pa.large_string())
    terms = pc.unique(flat)
    terms = terms.take(pc.sort_indices(terms))
    place = np.asarray(pc.index_in(flat, value_set=terms), np.int64)
    examples = []
    for i, c, a, b in zip(ids, y, edge[:-1], edge[1:]):
        order = np.argsort(place[a:b])
        examples.append((i, c, place[a:b][order], n[a:b][order]))
    size = [y.count(c) for c in (0, 1)]
    have = [np.bincount(np.concatenate([at for _, k, at, _ in examples if k == c] or [np.empty(0, np.int64)]), minlength=len(terms)) for c in (0, 1)]
    df, n = frequencies(docs, terms) if len(terms) else (np.empty(0), 0)
    weight = (np.log((1 + n) / (1 + df)) + 1) * relevance(have[1], have[0], size[1], size[0])
    known, order = zeros + ones, np.argsort(-weight, kind="stable")
    place = np.argsort(order)
    terms, weight = terms.take(pa.array(order)), weight[order]
    sort = lambda at, n: (lambda o: (place[at][o], n[o]))(np.argsort(place[at]))
    examples = [(i, c, *sort(at, n)) for i, c, at, n in examples]
    index = Index(terms, weight, examples, (zeros / known, ones / known) if known else (1.0, 0.0))
    index.calibrate()
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """id, score, evidence for every row of id, text. Null text counts as empty; repeated rows are scored each; an empty
    table gives an empty one. Without a known term the score is the calibrated share of toxic labels; without labels of
    both classes, that share."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        index = held.value
        for b in trimmed(batches):
            got = list(index.scores(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["id", "score", "evidence"])

    return docs.mapInArrow(run, "id long, score double, evidence array<long>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = fit(docs, labels, Work(spark, "toxicity"))
    out = score(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), index)
    return out.select(F.col("id").alias("doc_id"), (remainder("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
