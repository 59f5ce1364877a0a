"""Cross-tokenizer alignment: what two tokenizers make of the same bytes, group by group and link by link.

Of a portion of the texts, the different words are tokenised, each once, and linked in arrays (numpy and Arrow, in the tasks):
the ends of both sides, laid on one line of bytes, close stretches that one token of either side covers, which are links, and
where both end a group is closed. A text's groups and links are those of its words, since both sides end where a word ends. No
list is walked by Python or by an interpreted lambda.

How many documents hold a pair of ids linked is a sum over each document's different pairs. For the columns that need
those counts, the commonest pairs (KEPT at most) are broadcast, and the rest of the pairs, few rows each, are joined by
exchange; both give the same numbers.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import tokenizer_path
from .words import portions, spread
from .work import Work, table
from .worker import Memo, kept, trimmed

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that are broadcast at most.
KEPT = 1 << 20
#: Bytes of text whose different words are looked at together: the more, the fewer, and the larger a row.
PORTION = 2 << 20
#: Letters of new words that a tokenizer gets at a time, and bytes of words' ids that a worker keeps.
AT_ONCE, MEMORY = 1 << 16, 40 << 20
MARK = "▁"
#: Blanks that a word may begin with, and bytes that may end a character before one: see Tokens. The last byte of white
#: space beyond ASCII is in UNSURE, unless the byte before shows that it isn't white space.
BLANKS = np.isin(np.arange(256), [0x20, 0x0A, 0x09])
PRINTED = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
UNSURE = np.isin(np.arange(256), [*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
TWO = (np.arange(256) >= 0xC3) & (np.arange(256) < 0xE0)


def _byte_alphabet() -> dict[str, int]:
    """The letters of byte-level entries: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of both tokenizers for space + text.

    Texts are cut where a blank follows a character that is none: neither tokenizer joins anything over such a place (the
    first splits at white space; no piece of the second has a space after another character, or a line feed or tab beside
    others, which is checked), so the ids of each different word serve all its places, and a worker keeps those it has seen.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = _byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) and (MARK in piece.lstrip(MARK) or len(piece) > 1 and set(piece) & set("\n\t")):
                raise ValueError(f"{b_path} has a piece over a word's end: {piece!r}")
        if len(self.b.encode("a")) != 1:
            raise ValueError(f"{b_path} has no piece for a lone letter")
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.kept = Memo(MEMORY)

    def _pair(self, text: str) -> tuple[list[int], list[int] | None]:
        """The ids of a text that begins with a blank; no second ids if either side's bytes aren't the text's."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if MARK in text:
            return a, None
        b = self.b.encode("a" + text)[1:]  # the letter takes the blank that is added
        raw = text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return a, b if same else None

    @staticmethod
    def _value(a, b) -> bytes:
        """Ids in 32 bits: their number on the first side, then both; nothing if there are none."""
        return b"" if b is None else np.array([len(a), *a, *b], "<u4").tobytes()

    def _new(self, words: list[bytes]) -> Iterator[bytes]:
        """What is kept of each word. Words that end in no blank are put together: their ids fall apart at their ends."""
        at = 0
        while at < len(words):
            some, size = [], 0
            while at < len(words) and (not some or size < AT_ONCE):
                some.append(words[at].decode())
                size += len(words[at])
                at += 1
            sure = [w[-1] > " " and not w[-1].isspace() and MARK not in w for w in some]
            joined = "".join([w for w, ok in zip(some, sure) if ok])
            split = self._split(joined, words[at - len(some) : at], sure) if joined else iter(())
            if split is None:
                yield from (self._value(*self._pair(w)) for w in some)
            else:
                yield from (next(split) if ok else self._value(*self._pair(w)) for w, ok in zip(some, sure))

    def _split(self, joined: str, words: list[bytes], sure: list[bool]) -> Iterator[bytes] | None:
        """The values of words that were tokenised together, or None if a token reaches over an end or bytes differ."""
        a, b = self._pair(joined)
        if b is None:
            return None
        ends = np.cumsum([len(w) for w, ok in zip(words, sure) if ok])
        sides, numbers = [], []
        for ids, size in ((np.array(a, np.int64), self.a_size), (np.array(b, np.int64), self.b_size)):
            own = np.cumsum(size[ids])
            last = np.searchsorted(own, ends)
            if (own[last] != ends).any():
                return None
            sides.append(ids)
            numbers.append(np.diff(last, prepend=-1))
        total = 1 + numbers[0] + numbers[1]
        start = np.cumsum(total) - total
        out = np.empty(int(total.sum()), "<u4")
        out[start] = numbers[0]
        for ids, n, first in ((sides[0], numbers[0], start + 1), (sides[1], numbers[1], start + 1 + numbers[0])):
            out[np.arange(len(ids)) + np.repeat(first - (np.cumsum(n) - n), n)] = ids
        raw = out.tobytes()
        return iter([raw[x:y] for x, y in zip((4 * start).tolist(), (4 * (start + total)).tolist())])

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The code of every word of space + text in order, the number of words of each text, and the different words."""
        full = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        full = pa.concat_arrays([full, full[:0]])
        _, offsets, data = full.buffers()
        starts = np.frombuffer(offsets, np.int64)[full.offset : full.offset + len(full) + 1]
        t = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]]
        first = starts - starts[0]
        before = np.concatenate([[0, 0], t[:-1]]).astype(np.uint8)
        last, lead = before[1:], before[:-1]
        cut = BLANKS[t] & (PRINTED[last] | (last >= 0x80) & (TWO[lead] | ~UNSURE[last]))
        cut[first[:-1]] = True
        begin = np.flatnonzero(cut)
        sizes = np.diff(np.searchsorted(begin, first))
        at = np.append(begin, len(t)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(t.tobytes())]).dictionary_encode()
        return np.asarray(words.indices, np.int64), sizes.astype(np.int64), words.dictionary.to_pylist()

    def __call__(self, texts: pa.Array) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
        """For portions of the texts, in order: each text's words as places in a list, and of that list's words a_ids, a_ends,
        b_ids and b_ends. A text that is null, empty, or whose bytes aren't those of its tokens has no words."""
        kept = self.kept
        for begin, end in portions(texts, PORTION):
            own = texts[begin:end]
            some = np.asarray(pc.fill_null(pc.greater(pc.binary_length(own), 0), False))
            sizes = np.zeros(len(own), np.int64)
            codes, sizes[some], words = self._words(own.filter(pa.array(some))) if some.any() else (np.empty(0, np.int64), 0, [])
            held = list(map(kept.get, words))
            missing = [i for i, x in enumerate(held) if x is None]
            new = {}
            for i, x in zip(missing, self._new([words[i] for i in missing])):
                held[i] = new[words[i]] = x
            kept.learn(new)
            size = np.fromiter(map(len, held), np.int64, len(held)) // 4
            flat = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
            start, good = np.cumsum(size) - size, size > 0
            n_a = np.zeros(len(held), np.int64)
            n_a[good] = flat[start[good]]
            n_b = np.where(good, size - 1 - n_a, 0)
            of = np.repeat(np.arange(len(own)), sizes)
            whole = np.ones(len(own), bool)
            whole[of[~good[codes]]] = False
            kept_words = whole[of]
            places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(whole, sizes, 0))).astype(np.int32)), pa.array(codes[kept_words].astype(np.int32)))
            sides = ((start + 1, n_a, self.a_size), (start + 1 + n_a, n_b, self.b_size))
            yield places, [x for first, n, length in sides for x in self._lists(spread(flat, first, n), n, length)]

    @staticmethod
    def _lists(ids: np.ndarray, sizes: np.ndarray, length: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Lists of ids, and of their ends in bytes."""
        at = np.append(0, np.cumsum(sizes))
        ends = np.append(0, np.cumsum(length[ids]))
        ends = ends[1:] - np.repeat(ends[at[:-1]], sizes)
        offsets = pa.array(at.astype(np.int32))
        return tuple(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, ends))


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(np.asarray(lists.offsets)).astype(np.int64)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def _joined(items: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    """The strings up to each of the ends, which begin with 0, put together."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items), by)


def linked(sides: list[pa.ListArray]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of words with a_ids, a_ends, b_ids, b_ends: their groups' texts (`a1,a2|b1;...`) and numbers, the linked pairs of all
    words in order (the first side's id in the upper 32 bits), and their numbers.

    The words are laid end to end. Each end of a token, of either side, closes a stretch of bytes that one token of either side
    covers: as many tokens of a side lie before it as have ended earlier. A stretch is a link; where both sides end, it closes
    a group.
    """
    (a, a_ends), (b, b_ends) = ([np.asarray(x.values).astype(np.int64) for x in side] for side in (sides[:2], sides[2:]))
    n_a, n_b = _lengths(sides[0]), _lengths(sides[2])
    size = np.zeros(len(n_a), np.int64)
    size[n_a > 0] = a_ends[(np.cumsum(n_a) - 1)[n_a > 0]]
    at = _ends(size)
    closes = np.zeros(at[-1] + 1, np.uint8)
    closes[a_ends + np.repeat(at[:-1], n_a)] = 1
    closes[b_ends + np.repeat(at[:-1], n_b)] |= 2
    ends = np.flatnonzero(closes)
    done_a, done_b = np.cumsum(closes[ends] & 1, dtype=np.int64), np.cumsum(closes[ends] >> 1, dtype=np.int64)
    both = closes[ends] == 3
    pairs = (a[done_a - (closes[ends] & 1)] << 32) + b[done_b - (closes[ends] >> 1)]
    last = np.searchsorted(ends, at, side="right")
    texts = [_joined(pa.array(ids).cast(pa.string()), np.append(0, done[both]), ",") for ids, done in ((a, done_a), (b, done_b))]
    groups = _ends(both)[last]
    return _joined(pc.binary_join_element_wise(*texts, "|"), groups, ";"), np.diff(groups), pairs, np.diff(last)


def _documents(places: pa.ListArray, sides: list[pa.ListArray]) -> list[pa.Array]:
    """n_a, n_b, n_groups, n_links, groups, pairs and times of texts, from those of their words."""
    texts, n_groups, pairs, n_links = linked(sides)
    words, at = np.asarray(places.values), np.asarray(places.offsets)
    totals = [np.diff(_ends(n[words])[at]) for n in (_lengths(sides[0]), _lengths(sides[2]), n_groups, n_links)]
    own, codes = np.unique(pairs, return_inverse=True)
    held = spread(codes, (np.cumsum(n_links) - n_links)[words], n_links[words])
    held += np.repeat(np.arange(len(places)) * len(own), totals[3])
    held.sort()  # the pairs of each text in order, one text after another
    first = np.flatnonzero(np.diff(held, prepend=-1))
    of, code = np.divmod(held[first], max(1, len(own)))
    ends = pa.array(np.searchsorted(of, np.arange(len(places) + 1)).astype(np.int32))
    times = np.diff(first, append=len(held)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (own[code], times)]
    return [*map(pa.array, totals), _joined(texts.take(places.values), at, ";"), *lists]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of each of (doc_id, text), and pairs and times: the different linked
    pairs of ids in order, and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept("alignment", (a_path, b_path), lambda: Tokens(a_path, b_path))
        for b in trimmed(batches):
            done = 0
            for places, sides in tokens(b.column(1)):
                own = b.column(0)[done : done + len(places)]
                done += len(places)
                yield pa.RecordBatch.from_arrays([own, *_documents(places, sides)], ["doc_id", *COUNTS, "groups", "pairs", "times"])

    schema = T.StructType().add("doc_id", "long")
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("groups", "string").add("pairs", T.ArrayType(T.LongType(), False)).add("times", T.ArrayType(T.IntegerType(), False))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return df.select("doc_id", *COUNTS, sha.alias("groups_sha256"), "pairs", "times")


def counted(rows: DataFrame) -> DataFrame:
    """pair, held (the rows that hold it) and best (whether no other pair of its first id is held by more)."""
    pairs = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held")).withColumn("a", F.shiftright("pair", 32))
    most = pairs.groupBy("a").agg(F.max("held").alias("most"))
    return pairs.join(most.hint("merge"), "a").select("pair", "held", (F.col("held") == F.col("most")).alias("best"))


def _least(counts: DataFrame, kept: int) -> int:
    """A count that `kept` pairs at most reach: 1 if all pairs are so few, else the end of an eighth of a power of two."""
    step = F.floor(F.log2("held") * 8)
    sizes = sorted(((r["step"], r["n"], r["least"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("held").alias("least")).collect()), reverse=True)
    total, least = 0, None
    for _, n, low in sizes:
        total += n
        if total > kept:
            break
        least = low
    return least if least is not None else 1 << 62


def align(docs: DataFrame, work: Work, a_path: str | None = None, b_path: str | None = None, kept: int = KEPT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    A text that is null or empty, or whose tokens' bytes differ from space + text, has no tokens: zeros and ''. Rows that
    repeat a document, or have no id, are documents each, in the counts too; an empty table gives an empty one; other
    columns aren't read. A text's lists are in one row: it may have some hundred million tokens.
    """
    rows = aligned(docs, a_path or tokenizer_path(BYTES), b_path or tokenizer_path(PIECES))
    rows = work.save(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = work.save(counted(rows), "counts")
    least = _least(counts, kept)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    common, rare = F.broadcast(counts.where(F.col("held") >= least)), counts.where(F.col("held") < least)
    sums = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("held") * F.col("times")).alias("count_sum"))
    found = sums(links.join(common, "pair"))
    if least > 1:
        rest = links.join(common.select("pair"), "pair", "left_anti").join(rare.hint("merge"), "pair")
        found = found.unionByName(sums(rest)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", "times").join(found.hint("merge"), "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), Work(spark, "alignment"))
