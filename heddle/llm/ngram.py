"""Language-model scores by an interpolated, modified Kneser-Ney bigram model.

Counted in Spark, in three passes over compact partial counts (one row of sorted arrays for each task and bucket, so
what is exchanged follows the number of different n-grams in a task, and no word's counts meet as rows):

1. words: 64-bit hashes and counts, dealt by the hash's first bits. Each bucket writes a sorted hash array; a word's id
   is its place in all of them.
2. pairs: (context id, word id) keys and counts, dealt by a hash of the key, so that a common word spreads. Each bucket
   writes a sorted key array, and passes on, by id, what its pairs say of contexts (tokens, and pairs seen once, twice,
   more) and of words (different contexts).
3. ids: sums of those, written as arrays by id.

All arrays lie in the shared folder, written under another name and then renamed, so a task that runs again does no
harm. Workers map them into memory and score texts by binary search. With discounts D for pairs and E for
continuation counts, from counts of counts,

    p(w | h) = (c(hw) - D) / c(h) + g(h) q(w),    q(w) = (n(w) - E) / n + g / (V + 1)

where g(h) and g are the discounted mass and unknown words share one place, so p sums to 1 over V words and it.
"""

from __future__ import annotations

import atexit
import io
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import remainder
from .words import encoded, portions
from .work import Work, partitions, table
from .worker import kept, only, trimmed

END = b"\n"
#: Different words and tokens that a task holds before it hands on what it has counted.
WORDS, TOKENS = 400_000, 2_000_000
#: Buckets are a power of two, the number of shuffle partitions at least and 2 ** BITS at most.
BITS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words of texts, the number of words of each, and the hashes of the different words with A-Z lowered;
    words that differ in case alone have codes of their own, and hashes alike."""
    codes, sizes, words = encoded(texts)
    return codes, sizes, np.array([hash_of(w.lower()) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)


def with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with an end after each text, and where each text starts."""
    last = np.cumsum(sizes + 1) - 1
    out = np.empty(len(ids) + len(sizes), np.int64)
    word = np.ones(len(out), bool)
    word[last] = False
    out[word], out[last] = ids, end
    return out, last - sizes


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def hash_bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def key_bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return hash_bucket((keys ^ (keys >> np.uint64(32))) * _MIX, bits)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, by the planes of their bytes."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(b"".join(planes), 1)


def _loosen(raw: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(raw), [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        plane = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).view(k).ravel())
        at += n * size
    return out


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Different keys in order, and sums of the values of each."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def _write(uri: str, array: np.ndarray) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    buffer = io.BytesIO()
    np.save(buffer, array)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(buffer.getbuffer())
    fs.move(part, path)


def _own_folder() -> str:
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    return folder


def _map(uri: str) -> np.ndarray:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):  # a store that can't be mapped: one copy for each worker
        own = os.path.join(_own_folder(), uuid.uuid4().hex)
        pyarrow.fs.copy_files(path, own, source_filesystem=fs, destination_filesystem=pyarrow.fs.LocalFileSystem())
        path = own
    return np.load(path, mmap_mode="r")


def _row_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "n": pa.int64(), "data": pa.binary()}
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x]) for c, x in zip(cols, names)], names)


def _split(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each bucket that has any, in their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


class Words:
    """Ids of words, by the written hash arrays. Words outside have id `size` + 1; `size` is the begin of a text."""

    def __init__(self, root: str, bits: int, starts: list[int], size: int):
        self.root, self.bits, self.starts, self.size = root, bits, np.array(starts, np.int64), size
        self.arrays: dict[int, np.ndarray] = {}

    def hashes(self, b: int) -> np.ndarray:
        if b not in self.arrays:
            empty = self.starts[b] == self.starts[b + 1]
            self.arrays[b] = np.empty(0, np.uint64) if empty else _map(f"{self.root}/word-{b}")
        return self.arrays[b]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The ids of hashes."""
        out = np.full(len(h), self.size + 1, np.int64)
        order = np.argsort(h)
        h, got = h[order], np.full(len(h), self.size + 1, np.int64)
        for b, at in _split(hash_bucket(h, self.bits), 1 << self.bits):
            held = self.hashes(b)
            if len(held):
                place = np.minimum(np.searchsorted(held, h[at]), len(held) - 1)
                got[at] = np.where(held[place] == h[at], self.starts[b] + place, self.size + 1)
        out[order] = got
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of the texts, each text with its end, and where each text starts."""
        codes, sizes, h = words_of(texts)
        found = self.find(np.append(h, np.uint64(hash_of(END))))
        return with_ends(found[codes], sizes, int(found[-1]))


def _words(root: str, *args) -> Words:
    return kept(f"ngram {root}", root, lambda: Words(root, *args))


def count_words(texts: DataFrame, root: str, bits: int) -> list[tuple[int, int, int]]:
    """Writes the sorted hash arrays and their counts; returns bucket, different words and tokens."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, n = _summed(*(np.concatenate(x) for x in zip(*held)))
        rows = [(b, len(at), _squeeze(h[at], n[at].astype(np.uint32))) for b, at in _split(hash_bucket(h, bits), 1 << bits)]
        return _row_batch(rows, ["bucket", "n", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(f"ngram {root}")
        held, size = [], 0
        for b in trimmed(batches):
            for begin, end in portions(b.column(0)):
                codes, _, h = words_of(b.column(0)[begin:end])
                n = np.bincount(codes, minlength=len(h))
                held.append((np.append(h[n > 0], np.uint64(hash_of(END))), np.append(n[n > 0], end - begin)))
                size += len(h)
                if size > WORDS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_loosen(d, n, "<u8", "<u4") for d, n in zip(rows["data"], rows["n"])]
        h, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
        b = int(rows["bucket"].iloc[0])
        _write(f"{root}/word-{b}", h)
        _write(f"{root}/count-{b}", n)
        return pd.DataFrame({"bucket": [b], "words": [len(h)], "tokens": [int(n.sum())]})

    partial = texts.mapInArrow(count, "bucket int, n long, data binary")
    return [tuple(r) for r in partial.groupBy("bucket").applyInPandas(merge, "bucket int, words long, tokens long").collect()]


def count_pairs(texts: DataFrame, root: str, bits: int, starts: list[int], size: int, ranges: int) -> dict[str, list[int]]:
    """Writes the sorted key arrays with counts, and the arrays by id; returns counts of counts of pairs and of words'
    different contexts, and the number of different pairs."""
    width = -(-(size + 1) // ranges)

    def flush(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        rows = []
        for b, at in _split(key_bucket(key, bits), 1 << bits):
            own = key[at]
            context = (own >> np.uint64(32)).astype(np.uint32)
            rows.append((b, len(at), _squeeze(np.diff(context, prepend=np.uint32(0)), own.astype(np.uint32), n[at].astype(np.uint32))))
        return _row_batch(rows, ["bucket", "n", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, n = _words(root, bits, starts, size), [], 0
        for b in trimmed(batches):
            for begin, end in portions(b.column(0)):
                ids, first = vocabulary.ids(b.column(0)[begin:end])
                before = np.concatenate([[size], ids[:-1]])
                before[first] = size
                held.append((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
                n += len(ids)
                if n > TOKENS:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for d, n in zip(rows["data"], rows["n"]):
            gap, word, c = _loosen(d, n, "<u4", "<u4", "<u4")
            keys.append((np.cumsum(gap, dtype=np.uint64) << np.uint64(32)) | word)
            counts.append(c)
        key, n = _summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
        b = int(rows["bucket"].iloc[0])
        _write(f"{root}/pair-{b}", key)
        _write(f"{root}/times-{b}", n.astype(np.uint32) if n.max() < 1 << 32 else n)
        context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = []
        by_h = _summed(context, n, *((n == k).astype(np.int64) for k in (1, 2)), (n > 2).astype(np.int64))
        for r, at in _split(by_h[0] // width, ranges):
            out.append((r, 0, len(at), _squeeze(by_h[0][at].astype(np.uint32), by_h[1][at], *(x[at].astype(np.uint32) for x in by_h[2:]))))
        by_w = _summed(word, np.ones(len(word), np.int64))
        for r, at in _split(by_w[0] // width, ranges):
            out.append((r, 1, len(at), _squeeze(by_w[0][at].astype(np.uint32), by_w[1][at].astype(np.uint32))))
        out.append((0, 2, 5, _squeeze(np.array([*(int((n == k).sum()) for k in (1, 2, 3, 4)), b], np.int64))))
        return pd.DataFrame(out, columns=["bucket", "kind", "n", "data"])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        r = int(rows["bucket"].iloc[0])
        n = min(width, size + 1 - r * width)
        tokens, seen, contexts = np.zeros(n, np.int64), np.zeros((3, n), np.uint32), np.zeros(n, np.uint32)
        twice, buckets = np.zeros(4, np.int64), []
        for kind, m, d in zip(rows["kind"], rows["n"], rows["data"]):
            if kind == 0:
                i, c, *s = _loosen(d, m, "<u4", "<i8", "<u4", "<u4", "<u4")
                i = i.astype(np.int64) - r * width
                tokens[i] += c
                for k in range(3):
                    seen[k, i] += s[k]
            elif kind == 1:
                i, c = _loosen(d, m, "<u4", "<u4")
                contexts[i.astype(np.int64) - r * width] += c
            else:
                (*own, b) = _loosen(d, m, "<i8")[0].tolist()
                twice += own
                buckets.append(b)
        _write(f"{root}/tokens-{r}", tokens)
        _write(f"{root}/seen-{r}", seen)
        _write(f"{root}/contexts-{r}", contexts)
        own = [int((contexts == k).sum()) for k in (1, 2, 3, 4)]
        more = int((contexts > 2).sum())
        return pd.DataFrame({"pairs": [twice.tolist()], "words": [own], "more": [more], "types": [int(contexts.sum(dtype=np.int64))], "buckets": [buckets]})

    partial = texts.mapInArrow(count, "bucket int, n long, data binary")
    merged = partial.groupBy("bucket").applyInPandas(merge, "bucket int, kind int, n long, data binary")
    rows = merged.groupBy("bucket").applyInPandas(gather, "pairs array<long>, words array<long>, more long, types long, buckets array<long>").collect()
    total = lambda c: [sum(r[c][k] for r in rows) for k in range(4)]
    return {"pairs": total("pairs"), "words": total("words"), "more": sum(r["more"] for r in rows), "types": sum(r["types"] for r in rows), "buckets": {b for r in rows for b in r["buckets"]}}


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from counts of counts; where those are missing, the discount before, or one half."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
    out, last = [0.0], 0.5
    for k in (1, 2, 3):
        if n[k - 1] and n[k]:
            last = k - (k + 1) * y * n[k] / n[k - 1]
        last = min(max(last, 0.05), k - 0.05)
        out.append(last)
    return np.array(out)


class Model:
    """What workers need: where the arrays are, and a few numbers."""

    def __init__(self, root: str, bits: int, starts: list[int], size: int, tokens: int, ranges: int, seen: dict):
        self.root, self.bits, self.starts, self.size, self.tokens, self.ranges = root, bits, starts, size, tokens, ranges
        self.width = -(-(size + 1) // ranges)
        self.pair, self.word = discounts(seen["pairs"]), discounts(seen["words"])
        self.types, self.buckets = seen["types"], seen["buckets"]  # buckets that have pairs
        self.rest = (self.word[1] * seen["words"][0] + self.word[2] * seen["words"][1] + self.word[3] * seen["more"]) / self.types if self.types else 1.0

    def _array(self, name: str) -> np.ndarray:
        held = _words(self.root, self.bits, self.starts, self.size).arrays
        if name not in held:
            held[name] = _map(f"{self.root}/{name}")
        return held[name]

    def _by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        """The written array at sorted ids of words (or the begin)."""
        out = None
        for r, at in _split(ids // self.width, self.ranges):
            got = self._array(f"{name}-{r}")[..., ids[at] - r * self.width]
            if out is None:
                out = np.zeros((*got.shape[:-1], len(ids)), np.float64)
            out[..., at] = got
        return np.zeros(len(ids)) if out is None else out

    def _times(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        for b, at in _split(key_bucket(keys, self.bits), 1 << self.bits):
            if b not in self.buckets:
                continue
            held = self._array(f"pair-{b}")  # a lost file is an error
            place = np.minimum(np.searchsorted(held, keys[at]), len(held) - 1)
            hit = held[place] == keys[at]
            out[at[hit]] = self._array(f"times-{b}")[place[hit]]
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text."""
        size = self.size
        ids, starts = _words(self.root, self.bits, self.starts, size).ids(texts)
        lengths = np.diff(starts, append=len(ids))
        before = np.concatenate([[size], ids[:-1]])
        before[starts] = size
        word, place = np.unique(ids, return_inverse=True)
        known = word < size
        count, q = np.zeros(len(word)), np.full(len(word), self.rest / (size + 1))
        for b, at in _split(np.searchsorted(np.array(self.starts), word[known], side="right") - 1, 1 << self.bits):
            count[at] = self._array(f"count-{b}")[word[at] - self.starts[b]]
        base = np.log10((count + 1) / (self.tokens + size + 1))[place]
        if known.any():
            n = self._by_id("contexts", word[known])
            q[known] += (n - self.word[np.minimum(n, 3).astype(int)]) / self.types
        context, at = np.unique(before, return_inverse=True)
        seen = context <= size
        total, mass = np.zeros(len(context)), np.ones(len(context))
        if self.types:
            total[seen] = self._by_id("tokens", context[seen])
            ones, twos, more = self._by_id("seen", context[seen])
            held = total[seen]
            mass[seen] = np.where(held > 0, (self.pair[1] * ones + self.pair[2] * twos + self.pair[3] * more) / np.maximum(held, 1), 1.0)
        p = mass[at] * q[place]
        both = np.flatnonzero((before <= size) & (ids < size))
        if len(both) and self.types:
            keys, back = np.unique((before[both].astype(np.uint64) << np.uint64(32)) | ids[both].astype(np.uint64), return_inverse=True)
            times = self._times(keys)
            left = times - self.pair[np.minimum(times, 3).astype(int)]
            p[both] += np.where(times > 0, left, 0.0)[back] / np.maximum(total[at[both]], 1)
        sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.empty(0)
        return lengths, sums((ids < size).astype(np.int64)), sums(base), sums(np.log10(p))


def fit(texts: DataFrame, work: Work) -> Model:
    """The model of a table with a column text (null: empty). Only numbers for each bucket reach the driver."""
    spark = texts.sparkSession
    root = work.folder("model")
    if "://" not in root:
        root = root.replace("file:", "", 1)
        root = "file://" + root
    bits = min(BITS, max(0, math.ceil(math.log2(partitions(spark)))))
    held = dict((b, (w, t)) for b, w, t in count_words(texts, root, bits))
    starts = np.concatenate([[0], np.cumsum([held.get(b, (0, 0))[0] for b in range(1 << bits)])]).astype(int).tolist()
    size, tokens = starts[-1], sum(t for _, t in held.values())
    if size + 1 >= 1 << 32:
        raise ValueError(f"{size} different words: ids of 32 bits hold fewer")
    ranges = min(1 << bits, size + 1)
    ranges = -(-(size + 1) // -(-(size + 1) // ranges))
    seen = count_pairs(texts, root, bits, starts, size, ranges)
    return Model(root, bits, starts, size, tokens, ranges, seen)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """id, n_tokens, n_known, base_score, score of every row of id, text. Null text counts as empty: an end alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in trimmed(batches):
            for begin, end in portions(b.column(1)):
                got = model.score(b.column(1)[begin:end])
                yield pa.RecordBatch.from_arrays([b.column(0)[begin:end], *(pa.array(x) for x in got)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    held_out = remainder("id", 7) == 2
    model = fit(docs.where(~held_out).select("text"), Work(spark, "ngram"))
    out = score(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
