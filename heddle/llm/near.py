"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and chains of such.

Pairs are compared by their SimHash fingerprints (TABLES x 64 bits of the shingle set), bit-sliced, and links decided
by the sets themselves:

1. Rows with equal sets are one node, named by its smallest id.
2. Nodes meet in buckets: a node has BANDS keys of ROWS MinHash minima each. Blocks of fingerprint bits can't serve as
   keys here: at a similarity of 0.8 a bit differs with a probability of 0.15, and keys of few bits hold everything.
   Pairs at 0.8 share a bucket with a probability of 0.9999.
3. Each node of a bucket is compared with the bucket's smallest: pairs within RADIUS bits by simhash.near_pairs have
   their sets joined and intersected. At 0.8 the distance is 39 +- 6 bits, between unrelated texts 128 +- 8. Star rounds
   join the links found.
4. A bucket whose nodes are of one component by now is done. In the others every node outside the bucket's largest
   component is compared, likewise, with all nodes of other components. Large buckets are cut into chunks, and two
   chunks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import majority, near_pairs, votes
from .work import Work
from .worker import only, trimmed

SEED, SHINGLE, BANDS, ROWS = 42, 5, 24, 5
#: Words of a fingerprint, and the bits in which candidates may differ.
TABLES, RADIUS = 4, 80
#: Nodes in a chunk; a task compares two of them at a time.
CHUNK = 512
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_XOR, _ODD = _MIX[0], _MIX[1] | np.uint64(1)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's n-word shingles in order; fewer than n words: of the whole sequence; no word: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    last = ends[n - 1 :] if len(words) >= n else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[s:e], SEED) for s, e in zip(begins.tolist(), last.tolist())], np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """The band keys of a set of shingle hashes; an empty set has none."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, ((own[at : at + 1024, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    raw, width = least.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[width * b : width * (b + 1)], b) for b in range(BANDS)]


def alike(both: np.ndarray | int, one: np.ndarray | int, two: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of these sizes, with so many members in common, have a similarity of 0.8 or more."""
    return 5 * both >= 4 * (one + two - both)


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The majority bits of a set of shingle hashes; of an empty set 0."""
    return majority(votes(own, TABLES), len(own)) if len(own) else np.zeros(TABLES, np.uint64)


def relinked(ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that, with the components in label, have the components of all pairs that are alike. No set is empty."""
    label = np.unique(label, return_inverse=True)[1]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    prints = np.stack([fingerprint(s) for s in sets])
    todo, n = np.flatnonzero(label != np.bincount(label).argmax()), len(sets)
    a, b = [], []
    for at in range(0, len(todo), 64):
        one, two = np.repeat(todo[at : at + 64], n), np.tile(np.arange(n), len(todo[at : at + 64]))
        keep = (label[one] != label[two]) & alike(np.minimum(size[one], size[two]), size[one], size[two])
        one, two = one[keep], two[keep]
        near = near_pairs(prints[one], prints[two], RADIUS) if len(one) else []
        for u, v in zip(one[near].tolist(), two[near].tolist()):
            if label[v] != label[u] and alike(len(np.intersect1d(sets[u], sets[v], assume_unique=True)), size[u], size[v]):
                a.append(int(ids[u]))
                b.append(int(ids[v]))
                label[label == label[v]] = label[u]
    return a, b


def _sketches(docs: DataFrame) -> DataFrame:
    """id, 128 bits of hash of its set in h0 and h1, its fingerprint, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            only("simhash")
            whole, prints, keys = [], [], []
            for x in b.column(1):
                own = shingles(x.as_py())
                whole.append(xxhash.xxh3_128_digest(own.tobytes()))
                prints.append(fingerprint(own).tobytes())
                keys.append(np.array(bands(own), np.uint64).view(np.int64))
            h = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "h0", "h1", "fp", "bands"])

    return docs.mapInArrow(run, "id long, h0 long, h1 long, fp binary, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], ["id", "own"])

    return docs.mapInArrow(run, "id long, own binary")


def _close(pairs: DataFrame) -> DataFrame:
    """pairs: a, b and their fingerprints in x, y. Returns a, b of the pairs within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, TABLES) for k in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(near_pairs(x, y, RADIUS)))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame) -> DataFrame:
    """pairs: a, b and their sets in x, y. Returns a, b of the pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                near = bool(alike(min(len(x), len(y)), len(x), len(y)))  # else the sizes alone rule it out
                keep.append(near and bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _rest(members: DataFrame, sets: DataFrame, work: Work, chunk: int) -> DataFrame:
    """members: key, id, component of the buckets with several components. Returns the links that are missing, as a, b."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("m"))
    big = work.save(sizes.where("m > 1"), "big")
    # a bucket of one chunk meets itself; row i of a larger one goes to every pair (i, j)
    dealt = members.join(big, "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("id", F.lit(7)), F.col("m")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "id", "component").join(sets.hint("merge"), "id")
    tasks = dealt.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("id", "component", "own")).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            a, b = [], []
            for held in batch.column(3):
                nodes = held.values
                ids, label = (np.asarray(nodes.field(k)) for k in (0, 1))
                if len(ids) > 1:
                    x, y = relinked(ids, [np.frombuffer(v.as_py(), np.uint64) for v in nodes.field(2)], label)
                    a += x
                    b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tasks.mapInArrow(run, "a long, b long")


def kept(docs: DataFrame, id_col: str, work: Work, chunk: int = CHUNK) -> DataFrame:
    """The smallest id of every group of near copies, and of every document that has none, in `id`.

    Ids must be different and known. Null texts count as empty, and texts without words are one group.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sketches = work.save(_sketches(texts), "sketches")
    nodes = work.save(sketches.groupBy("h0", "h1").agg(F.min("id").alias("id")).select("id"), "nodes")
    keys = sketches.join(nodes, "id", "left_semi").select("id", F.explode("bands").alias("key"))
    buckets = work.save(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low"), "buckets")
    members = work.save(keys.join(buckets, "key"), "members")
    # texts and sets move at every size: the other side grows with the documents
    sets = work.save(_sets(texts.join(members.select("id").distinct().hint("merge"), "id", "left_semi")), "sets")
    pairs = members.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    print_of = lambda k, fp: sketches.select(F.col("id").alias(k), F.col("fp").alias(fp))
    pairs = work.save(_close(pairs.join(print_of("a", "x"), "a").join(print_of("b", "y"), "b")), "pairs")
    one, two = (sets.select(F.col("id").alias(k), F.col("own").alias(own)).hint("merge") for k, own in (("a", "x"), ("b", "y")))
    pairs = pairs.join(one, "a").join(two, "b")
    found = work.save(components(work, work.save(_verified(pairs), "stars")), "found")
    named = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    named = work.save(named, "named")
    # of buckets with the same nodes one is enough
    same = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("s0"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s1")]
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *same).where("low < high")
    mixed = work.save(mixed.groupBy("n", "s0", "s1").agg(F.min("key").alias("key")).select("key"), "mixed")
    more = work.save(_rest(named.join(mixed, "key", "left_semi"), sets, work, chunk), "more")
    links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    last = components(work, links)
    return nodes.join(last.where("node <> component").select(F.col("node").alias("id")), "id", "left_anti")
