"""SimHash near-duplicate groups, compared bit-sliced.

fingerprints() gives each text 64 majority bits of its word-shingle hashes. groups() links fingerprints within a
radius and returns the group of every row:

1. Equal fingerprints are one node, named by its smallest id, so copies never meet as pairs.
2. Fingerprints within radius r agree on one of r + 1 blocks of bits (or on a pair, triple, ... of more blocks), so
   nodes are dealt by those blocks. Small buckets are packed together, large ones cut into chunks, and a chunk meets
   every other chunk of its bucket in a task of its own. No task holds more than two chunks.
3. Two chunks are compared by bit planes: plane j holds bit j of 64 nodes in each word. A query's planes are XORed
   into carry-save counters (ones, twos, over) of all lanes at once, and words whose 64 lanes all exceed the radius
   are given up.
4. A chunk pair returns a spanning forest of its links, and star rounds join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .work import Work, table
from .worker import only, trimmed

SEED = 42
RADIUS = 3
SHINGLE = 3
#: Nodes in a chunk; a task compares two of them at a time.
CHUNK = 512
#: Beyond so many nodes, six blocks (keys of 32 bits) are used in place of four (16 bits); the links found are the same.
MANY = 1 << 25


def votes(h: np.ndarray, tables: int) -> np.ndarray:
    """How many of the hashes have each bit, by table. The first table's bits are the hash's own, another's those of an odd
    multiple of it, mixed."""
    counts = np.zeros((tables, 64), np.int64)
    for t in range(tables):
        x = h
        if t:
            x = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * t + 1)) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # so many fit a byte
            counts[t] += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return counts


def majority(counts: np.ndarray, of: int) -> np.ndarray:
    """A fingerprint of 64 bits for each table: those set in over half of so many hashes."""
    return np.packbits(2 * counts > of, axis=1, bitorder="little").view("<u8").ravel()


def majorities(text: str | None, n: int = SHINGLE, seed: int = SEED, tables: int = 1) -> list[int]:
    """The fingerprints of one text as unsigned numbers; no word: 0; fewer than n words: the whole sequence is hashed.

    Bits are those of the XXH64 of each shingle; see votes().
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * tables
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    k = max(1, len(words) - n + 1)
    last = ends[n - 1 :] if len(words) >= n else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((tables, 64), np.int64)
    for at in range(0, k, 1 << 16):
        counts += votes(np.array([digest(flat[s:e], seed) for s, e in zip(begins[at : at + (1 << 16)].tolist(), last[at : at + (1 << 16)].tolist())], np.uint64), tables)
    return majority(counts, k).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, tables: int = 1) -> DataFrame:
    """id and, for each table, fp0, fp1, ... (64 bits as a signed long). Null texts count as empty and get 0."""
    names = [f"fp{t}" for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            only("simhash")
            fp = np.array([majorities(x.as_py(), n, SEED, tables) for x in b.column(1)], np.uint64).reshape(b.num_rows, tables)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(fp[:, t]).view(np.int64)) for t in range(tables))], ["id", *names])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in names))


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane j is bit j of fingerprint 64 w + i. Lanes past the end stay 0."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in queries, in lanes) of all pairs at radius or fewer differing bits; radius is below 4."""
    store = planes(lanes)
    q = np.repeat(np.arange(len(queries)), store.shape[1])
    w = np.tile(np.arange(store.shape[1]), len(queries))
    ones, twos, over = (np.zeros(len(q), np.uint64) for _ in range(3))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(64):
        diff = store[j][w] ^ np.where((queries[q] >> np.uint64(j)) & np.uint64(1), full, np.uint64(0))
        carry = ones & diff
        ones ^= diff
        over |= twos & carry
        twos ^= carry
        if j in (11, 15, 19, 23, 27, 31, 39, 47, 55):  # give up the words all of whose lanes are out
            out = over | (ones & twos if radius < 3 else np.uint64(0)) | (twos if radius < 2 else np.uint64(0)) | (ones if radius < 1 else np.uint64(0))
            keep = out != full
            if not keep.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            q, w, ones, twos, over = q[keep], w[keep], ones[keep], twos[keep], over[keep]
    near = ~(over | (ones & twos if radius < 3 else np.uint64(0)) | (twos if radius < 2 else np.uint64(0)) | (ones if radius < 1 else np.uint64(0)))
    hit = np.flatnonzero(near)
    lane = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(len(hit), 8), axis=1, bitorder="little")
    row, bit = np.nonzero(lane)
    left, right = q[hit][row], w[hit][row] * 64 + bit
    real = right < len(lanes)
    return left[real], right[real]


class Lanes:
    """Bit-sliced counters of 64 lanes to a word. Planes are added as pairs wait at each level for a carry-save adder, so
    a plane costs about five word operations whatever the counters' width."""

    def __init__(self, words: int, levels: int):
        self.sums = [np.zeros(words, np.uint64) for _ in range(levels)]
        self.waiting: list[np.ndarray | None] = [None] * levels

    def add(self, plane: np.ndarray, level: int = 0) -> None:
        one = self.waiting[level]
        if one is None:
            self.waiting[level] = plane
            return
        self.waiting[level], own = None, self.sums[level]
        either = one ^ plane
        self.sums[level] = own ^ either
        if level + 1 < len(self.sums):
            self.add((one & plane) | (own & either), level + 1)

    def over(self, radius: int) -> np.ndarray:
        """The lanes whose count is above the radius."""
        for level, one in enumerate(self.waiting):  # what still waits is added with a carry
            while one is not None and level < len(self.sums):
                self.sums[level], one = self.sums[level] ^ one, self.sums[level] & one
                level += 1
        self.waiting = [None] * len(self.sums)
        more, same = np.zeros_like(self.sums[0]), ~np.zeros_like(self.sums[0])
        for level in reversed(range(len(self.sums))):
            if radius >> level & 1:
                same = same & self.sums[level]
            else:
                more |= same & self.sums[level]
                same = same & ~self.sums[level]
        return more

    def keep(self, at: np.ndarray) -> None:
        self.sums = [x[at] for x in self.sums]


def near_pairs(one: np.ndarray, two: np.ndarray, radius: int, every: int = 64) -> np.ndarray:
    """Whether each row of fingerprints in `one` (rows, words of 64 bits) differs in `radius` bits at most from its row of
    `two`. Differences are stored as bit planes, 64 pairs to a word, and a word all of whose pairs exceed the radius
    after some planes is given up."""
    rows, width = one.shape
    words = -(-rows // 64)
    bits = np.zeros((words * 64, width * 64), np.uint8)
    bits[:rows] = np.unpackbits(np.ascontiguousarray(one ^ two).view(np.uint8).reshape(rows, -1), axis=1)
    store = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    lanes, at, far = Lanes(words, int(width * 64).bit_length()), np.arange(words), ~np.zeros(words, np.uint64)
    for j, plane in enumerate(store, 1):
        lanes.add(plane[at])
        if j % every == 0 or j == len(store):
            out = lanes.over(radius)
            left = out != ~np.uint64(0)
            lanes.keep(left)
            at, out = at[left], out[left]
            if not len(at):
                break
    far[at] = out
    return np.unpackbits((~far).view(np.uint8), bitorder="little")[:rows].astype(bool)


def forest(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links between positions: every other node with the component's smallest."""
    label = nodes.copy()
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        if (new == label).all():
            break
        label = new
    moved = label != nodes
    return nodes[moved], label[moved]


def links(work: Work, nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, many: int = MANY) -> DataFrame:
    """nodes: fp, first (distinct in both). Returns a, b: links whose components are those of all pairs within radius."""
    n = nodes.count()
    blocks = 4 if n <= many else 6
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for t, kept in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(t).cast("long")
        for i in kept:
            width = cuts[i + 1] - cuts[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    bits = max(sum(cuts[i + 1] - cuts[i] for i in kept) for kept in combinations(range(blocks), blocks - radius))
    packed = max(1, min(1 << 15, int(chunk * (1 << bits) / 2 / max(n, 1))))  # neighbouring buckets that share a chunk
    dealt = nodes.select("fp", "first", F.explode(F.array(*keys)).alias("key")).select("fp", "first", F.floor(F.col("key") / packed).cast("long").alias("g"))
    sizes = dealt.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("m"))
    big = work.save(sizes.where("m > 1"), "big")
    # a bucket of one chunk meets itself; row i of a larger one goes to every pair (i, j)
    sized = dealt.join(big, "g", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    sized = sized.withColumn("i", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("m")).cast("int"))
    pairs = sized.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = pairs.select("g", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "fp", "first")
    tasks = pairs.groupBy("g", "lo", "hi").agg(F.collect_list("i").alias("side"), F.collect_list("fp").alias("fps"), F.collect_list("first").alias("firsts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            a_out, b_out = [], []
            for lo, hi, side, fps, firsts in zip(*(b.column(c) for c in (1, 2, 3, 4, 5))):
                side, fps, firsts = (np.asarray(x.values) for x in (side, fps, firsts))
                if len(fps) < 2:
                    continue
                fps = fps.view(np.uint64)
                if lo.as_py() == hi.as_py():
                    left, right = within(fps, fps, radius)
                    keep = left < right
                    left, right = left[keep], right[keep]
                else:
                    ones, twos = np.flatnonzero(side == lo.as_py()), np.flatnonzero(side == hi.as_py())
                    if not len(ones) or not len(twos):
                        continue
                    left, right = within(fps[ones], fps[twos], radius)
                    left, right = ones[left], twos[right]
                x, y = forest(firsts, left, right)
                a_out.append(x)
                b_out.append(y)
            cat = lambda v: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([cat(a_out), cat(b_out)], ["a", "b"])

    return tasks.mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, work: Work, radius: int = RADIUS, chunk: int = CHUNK, many: int = MANY) -> DataFrame:
    """prints: id, fp0, fp1, ... (written). Adds component_id: the smallest id reachable over links, itself included.

    Rows are linked if their fingerprints in any one table are within the radius. Ids are expected to be unique; repeated
    ids stay as rows and share a group only if linked. A row without id joins the group of its first fingerprint; where
    no id of that group is known, its component is null.
    """
    tables = [c for c in prints.columns if c != "id"]
    every, firsts = None, []
    for fp in tables:
        known = work.save(prints.groupBy(F.col(fp).alias("fp")).agg(F.min("id").alias("first")), "nodes")
        firsts.append(known)
        own = links(work, known.where("first is not null"), radius, chunk, many)
        if fp != tables[0]:  # a group of equal fingerprints has a name in each table
            name0, name = (k.where("first is not null").select(F.col("fp").alias(f"__{x}"), F.col("first").alias(x)) for k, x in ((firsts[0], "a"), (known, "b")))
            same = prints.where("id is not null").select(F.col(tables[0]).alias("__a"), F.col(fp).alias("__b")).distinct()
            same = same.join(name0, "__a").join(name, "__b").select("a", "b").where("a <> b").distinct()
            own = own.unionByName(same)
        own = work.save(own, "links") if len(tables) > 1 else own  # else one plan would hold the joins of all tables
        every = own if every is None else every.unionByName(own)
    found = work.save(components(work, every), "found")
    moved = firsts[0].join(found.withColumnRenamed("node", "first"), "first", "left")
    lookup = work.save(moved.select(F.col("fp").alias("__fp"), F.coalesce("component", "first").alias("component_id")), "lookup")
    return prints.join(lookup, prints[tables[0]] == lookup["__fp"], "left").select(*prints.columns, "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, n: int = SHINGLE, tables: int = 1) -> DataFrame:
    """Fingerprints and group of every document: id, fp0, ..., component_id.

    Null and empty texts have fingerprint 0 and are linked like any others; an empty table gives an empty one;
    other columns of docs are not read, whatever their names.
    """
    work = Work(docs.sparkSession, "simhash")
    return groups(work.save(fingerprints(docs, id_col, text_col, n, tables), "prints"), work, radius)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
