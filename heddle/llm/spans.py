"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? before white space, and after line feeds); a sentence of more than LONG words
is cut further after words chosen by their own hash, so it falls apart alike wherever it stands. A span is a run of two
sentences at least that holds LEAST words at least, the length from which a repeat counts. Every run that repeats is the
union of the shortest spans from its sentences onwards and from its sentences' ends backwards, so these are hashed (over
their words in lower case, white space ignored) and joined over all documents:

1. the spans onwards of all documents; every repeated run has one;
2. of documents that share one, the spans backwards, which reach the ends of repeated runs.

A sentence covered by a span whose first document (smallest id) is another one is removed, and so is one covered by a
later occurrence within the document that doesn't overlap the first one: of a line repeated over and over, the span that it
begins with stays.

Within a document a repeat is seen at once, so only a row for each document and different span is exchanged: first to
find the smallest id of spans in two documents or more, then to tell the other documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import spare, table, Work
from .worker import only, trimmed

LEAST, LONG, MARK = 16, 16, 4
#: Rows that a worker returns at a time.
ROWS = 1000
_CUT = re.compile(r"(?<=[.!?])(?=[ \t\r\n\v\f])|(?<=\n)")
_WORD = re.compile(r"\S+")


def sentences(text: str) -> tuple[list[str], list[int], bytes]:
    """Parts whose concatenation is the text, their numbers of words, and 8 bytes of hash for each."""
    parts: list[str] = []
    sizes: list[int] = []
    hashes: list[bytes] = []
    blank = ""
    digest = xxhash.xxh64_digest
    for part in _CUT.split(text):
        words = part.split()
        if not words:  # white space belongs to the sentence before it
            if parts:
                parts[-1] += part
            else:
                blank += part
            continue
        if blank:
            part, blank = blank + part, ""
        if len(words) <= LONG:
            parts.append(part)
            sizes.append(len(words))
            hashes.append(digest(" ".join(words).lower().encode("utf-8", "surrogatepass")))
            continue
        begin = first = 0
        for i, m in enumerate(_WORD.finditer(part), 1):
            if i == len(words) or crc32(m[0].encode("utf-8", "surrogatepass")) % MARK == 0:
                end = len(part) if i == len(words) else m.end()
                parts.append(part[begin:end])
                sizes.append(i - first)
                hashes.append(digest(" ".join(words[first:i]).lower().encode("utf-8", "surrogatepass")))
                begin, first = end, i
    if blank:
        parts.append(blank)
        sizes.append(0)
        hashes.append(digest(b""))
    return parts, sizes, b"".join(hashes)


def onwards(sizes: list[int], hashes: bytes, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(first, end, hash) of the shortest span from every sentence."""
    found, end, words, n = [], 0, 0, len(sizes)
    digest = xxhash.xxh64_intdigest
    for first in range(n - 1):
        while end < n and (words < least or end < first + 2):
            words += sizes[end]
            end += 1
        if words < least:
            break
        found.append((first, end, digest(hashes[8 * first : 8 * end])))
        words -= sizes[first]
    return found


def backwards(sizes: list[int], hashes: bytes, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(first, end, hash) of the shortest span before every sentence's end."""
    found, words, first = [], 0, len(sizes)
    digest = xxhash.xxh64_intdigest
    for end in range(len(sizes), 1, -1):
        while first and (words < least or first > end - 2):
            first -= 1
            words += sizes[first]
        if words < least:
            break
        found.append((first, end, digest(hashes[8 * first : 8 * end])))
        words -= sizes[end - 1]
    return found


def covered(text: str, gone: set[int], least: int = LEAST) -> tuple[list[str], np.ndarray]:
    """The text's parts, and which of them a span in `gone`, or a repeat within the text, covers."""
    parts, sizes, hashes = sentences(text)
    own = onwards(sizes, hashes, least)
    if gone or len({h for _, _, h in own}) < len(own):
        own = sorted({*own, *backwards(sizes, hashes, least)})
    out, kept = np.zeros(len(parts), bool), {}
    for first, end, h in own:
        if h in gone or first >= kept.setdefault(h, end):
            out[first:end] = True
    return parts, out


def dedup(docs: DataFrame, work: Work, least: int = LEAST) -> DataFrame:
    """id, text and any further columns of docs (id long, text string) with text cut, removed (sentences) and cuts (starts
    and ends of what was removed, in characters of the old text); these two names get '_' added while a further column has
    them. Spans hold `least` words or more: with 1 every repeated run of two sentences goes.

    Null text stays null and empty text empty. Rows with the same id count as one document. A row without id loses
    only its own repeats. A text of one sentence, or of fewer than LEAST words, has no span and stays as it is. An empty
    table gives an empty one.
    """

    def hashes(back: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only("spans")
            for b in trimmed(batches):
                ids, out, again = [], [], []
                for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                    _, sizes, hashes = sentences(text.as_py())
                    found = onwards(sizes, hashes, least)
                    own = {h for _, _, h in found}
                    twice = not back and len(own) < len(found)
                    if back:
                        own = {h for _, _, h in backwards(sizes, hashes, least)} - own
                    ids.append(np.full(len(own), i, np.int64))
                    out.append(np.fromiter(own, np.uint64, len(own)))
                    again.append(np.zeros(len(own), bool))
                    again[-1][:1] = twice  # said once for a document
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(again))], ["id", "h", "again"])

        return run

    def repeats(texts: DataFrame, back: bool) -> tuple[DataFrame, DataFrame]:
        """id, h, first of every document's spans that another document has too; and id of those that repeat their own."""
        found = work.save(texts.mapInArrow(hashes(back), "id long, h long, again boolean"), "spans")
        known = found.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last"))
        known = work.save(known.select("h", "first"), "first")
        both = work.save(found.drop("again").join(known.hint("merge"), "h"), "repeats")
        alone = None if back else work.save(found.where("again").select("id").distinct(), "alone")
        work.drop(found, known)
        return both, alone

    texts = docs.where("id is not null and text is not null").select("id", "text")
    some, alone = repeats(texts, False)
    more, _ = repeats(texts.join(some.select("id").distinct().hint("merge"), "id", "left_semi"), True)
    extra = [c for c in docs.columns if c not in ("id", "text")]
    mark, removed_, cuts_ = (spare(x, docs.columns) for x in ("gone", "removed", "cuts"))
    gone = some.unionByName(more).where(F.col("id") > F.col("first")).select("id", "h").unionByName(alone.withColumn("h", F.lit(None).cast("long")))
    gone = work.save(gone.groupBy("id").agg(F.collect_set("h").alias(mark)), "gone")  # an empty set: only its own repeats
    work.drop(some, more, alone)
    joined = docs.join(gone.hint("merge"), "id", "left").select("id", "text", mark, *extra)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("spans")
        for whole in trimmed(batches):
            for begin in range(0, whole.num_rows, ROWS):
                b = whole.slice(begin, ROWS)
                texts, removed, cuts = [], [], []
                for i, text, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    text, own = text.as_py(), own.as_py()
                    if text is None or own is None and i is not None:  # no span of it is repeated anywhere
                        texts.append(text)
                        removed.append(0)
                        cuts.append([])
                        continue
                    parts, out = covered(text, {h & 0xFFFFFFFFFFFFFFFF for h in own or ()}, least)
                    texts.append("".join([p for p, x in zip(parts, out) if not x]) if out.any() else text)
                    removed.append(int(out.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
                    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                    cuts.append(at[edge].tolist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32()), pa.array(cuts, pa.list_(pa.int64())), *b.columns[3:]], ["id", "text", removed_, cuts_, *extra])

    schema = T.StructType().add("id", "long").add("text", "string").add(removed_, "integer").add(cuts_, T.ArrayType(T.LongType()))
    for c in extra:
        schema.add(docs.schema[c])
    return joined.mapInArrow(cut, schema)


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return dedup(docs, Work(spark, "spans")).select(F.col("id").alias("doc_id"), "text", "removed", "cuts")
