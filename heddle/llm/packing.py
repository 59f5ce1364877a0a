"""Best-fit packing of documents into token sequences, after Martello and Toth's dominance reduction.

Only the number of pieces of each length matters to a packing, and there are at most `capacity` lengths. So the plan is
made from that histogram, in bulk, on the driver: its size depends on the capacity, not on the documents. First sets
that dominate every other set with the same longest piece are fixed for good: a piece that no other fits beside, a
pair that fills a sequence exactly, and a piece that at most one other fits beside together with the longest that
does. The shrunk instance is packed best fit, longest first. Pieces find their place by their rank among those of
their length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import encoded, portions, spread
from .work import Work, ranked, table
from .worker import kept, Memo, trimmed

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"

#: Bytes of words' ids that a worker keeps; most of the work is words that it doesn't.
KEPT = 100 << 20
#: Words that the tokenizer gets at a time; what it returns is some hundred times as large.
AT_ONCE = 1000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Little-endian 32-bit ids of texts, as their tokenizer gives them without special tokens added.

    The tokenizer must never join text across white space, so that the ids of each different word serve all its places;
    one that fails PROBE is refused. A text that may hold a special token's own string is given to the tokenizer whole.
    """

    PROBE = "One two,  three\nfour's\t5 six. Ünï!\v a\fb\rc 's it 's"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), Memo(KEPT)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        if self._new([self.PROBE])[0] != b"".join(self._new(self.PROBE.split())):
            raise ValueError(f"{path} joins text across white space")

    def _new(self, chunks: list[str]) -> list[bytes]:
        parts = (chunks[at : at + AT_ONCE] for at in range(0, len(chunks), AT_ONCE))
        return [np.asarray(x.ids, "<u4").tobytes() for p in parts for x in self.tokenizer.encode_batch_fast(p, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order; null counts as empty."""
        kept = self.kept
        for begin, end in portions(texts):
            own = pc.fill_null(texts[begin:end], "")
            odd = np.zeros(len(own), bool)
            for s in self.special:
                odd |= np.asarray(pc.match_substring(own, s))
            codes, sizes, words = encoded(own)
            words = words.to_pylist()
            held = list(map(kept.get, words))
            missing = [i for i, x in enumerate(held) if x is None]
            new = {}
            for i, x in zip(missing, self._new([words[i] for i in missing])):
                held[i] = new[words[i]] = x
            kept.learn(new)
            size = np.fromiter(map(len, held), np.int64, len(held)) // 4
            flat = spread(np.frombuffer(b"".join(held), "<u4"), (np.cumsum(size) - size)[codes], size[codes])
            at = np.append(0, np.cumsum(size[codes]))[np.append(0, np.cumsum(sizes))]
            for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                yield self._new([own[i].as_py()])[0] if odd[i] else flat[x:y].tobytes()


def word_ids(path: str) -> WordIds:
    return kept("packing", path, lambda: WordIds(path))


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. Null text counts as empty: a piece with the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = word_ids(path), np.asarray([END], "<u4").tobytes()
        for b in trimmed(batches):
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), ids(b.column(1))):
                raw += end
                for at in range(0, len(raw), 4 * capacity):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs of pieces: of a length, from a rank on, so many to a sequence, from a sequence and offset on."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self.left = {s: n for s, n in counts.items() if n}
        self.rank = dict.fromkeys(counts, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, per sequence, first sequence, offset
        self.open: dict[int, deque] = {}
        self.room: list[int] = []
        self._reduce()
        self._best_fit()

    def _put(self, size: int, n: int, per: int, first: int, offset: int) -> None:
        self.runs.append((size, self.rank[size], per, first, offset))
        self.rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    def _fix(self, sets: int, *sizes: int) -> None:
        if len(sizes) == 2 and sizes[0] == sizes[1]:
            self._put(sizes[0], 2 * sets, 2, self.bins, 0)
        else:
            offset = 0
            for s in sizes:
                self._put(s, sets, 1, self.bins, offset)
                offset += s
        self.bins += sets

    def _reduce(self) -> None:
        sizes, moved = sorted(self.left), True
        while moved:
            moved, low = False, 0
            for s in reversed(sizes):
                n = self.left.get(s, 0)
                if not n:
                    continue
                rest, small = self.capacity - s, []
                while sizes[low] not in self.left:
                    low += 1
                for x in sizes[low:]:  # the two shortest pieces beside this one
                    small += [x] * min(3, self.left.get(x, 0) - (x == s))
                    if len(small) > 1:
                        break
                if not small or small[0] > rest:
                    self._fix(n, s)
                elif self.left.get(rest, 0) and (rest != s or n > 1):
                    self._fix(n // 2 if rest == s else min(n, self.left[rest]), s, rest)
                elif len(small) == 1 or small[0] + small[1] > rest:
                    at = bisect_left(sizes, rest + 1) - 1
                    while sizes[at] not in self.left or sizes[at] == s and n < 2:
                        at -= 1
                    other = sizes[at]
                    self._fix(n // 2 if other == s else min(n, self.left[other]), s, other)
                else:
                    continue
                moved = True
            sizes = sorted(self.left)

    def _free(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.open:
                self.open[room] = deque()
                insort(self.room, room)
            self.open[room].append((first, n))

    def _best_fit(self) -> None:
        for s in sorted(self.left, reverse=True):
            while s in self.left:
                n, at = self.left[s], bisect_left(self.room, s)
                if at == len(self.room):
                    room, first, bins = self.capacity, self.bins, -(-n // (self.capacity // s))
                    self.bins += bins
                else:
                    room = self.room[at]
                    first, bins = self.open[room].popleft()
                    if not self.open[room]:
                        del self.open[room]
                        self.room.pop(at)
                per = room // s
                full, more = divmod(n, per)
                if full >= bins:
                    full, more = bins, 0
                if full:
                    self._put(s, full * per, per, first, self.capacity - room)
                    self._free(room - per * s, first, full)
                if more:
                    self._put(s, more, more, first + full, self.capacity - room)
                    self._free(room - more * s, first + full, 1)
                self._free(room, first + full + bool(more), bins - full - bool(more))

    def arrays(self) -> tuple[np.ndarray, ...]:
        runs = sorted(self.runs)
        table = np.array(runs, np.int64).reshape(len(runs), 5)
        return (table[:, 0] << 40) + table[:, 1], *(table[:, i] for i in range(2, 5))


def _places(held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, per, first, offset = held.value
        for b in trimmed(batches):
            length, place = np.asarray(b.column("length")), np.asarray(b.column("place")) - 1
            key = (length << 40) + place
            at = np.searchsorted(keys, key, side="right") - 1
            i = key - keys[at] if len(keys) else key
            cols = b.columns[:-1] + [pa.array(first[at] + i // per[at]), pa.array(offset[at] + i % per[at] * length)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, work: Work, capacity: int = CAPACITY) -> DataFrame:
    """pieces: doc_id, piece, start, length, ids_crc32 (written). Adds sequence_id and offset.

    Repeated rows are pieces each; equal lengths are placed in (doc_id, piece) order, null ids last. An empty table gives
    an empty one. The histogram has at most `capacity` rows.
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    held = work.spark.sparkContext.broadcast(Plan(counts, capacity).arrays())
    kinds = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return ranked(work, pieces, ["length"], ["doc_id", "piece"], "place").mapInArrow(_places(held), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their places in sequences of at most `capacity` tokens; see cut() and pack()."""
    work = Work(docs.sparkSession, "packing")
    return pack(work.save(cut(docs, path or tokenizer_path(), capacity), "pieces"), work, capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
