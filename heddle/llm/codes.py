"""Vector code compression: every part of a vector becomes the index of its nearest codebook entry.

Components are integers, so every distance is one. A worker screens with a float32 matrix product: x.c is off by at most
(d + 2) * 2^-24 * |x|.|c| (products and sums of d terms, and both factors rounded to float32), which gives each distance
an interval. Entries whose interval overlaps the best one's are evaluated again in int64, and of equal distances the
smallest index wins; the result is that of exact arithmetic. Vectors with components of 2^22 or more, whose squares int64
might not hold, are evaluated in Python integers.

The rounds are Spark jobs over one written table of integer vectors. A task sends a sum and a count for each part and
entry; Spark adds them up, and the driver gets one row for each: PARTS x ENTRIES rows, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Work, table
from .worker import trimmed

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that are compared at a time.
TILE = 4096
#: Below this magnitude the squared distance of 2^17 components fits an int64.
SAFE = 1 << 22
#: Largest long: larger errors (of components beyond some 2^31) are given as this.
LONGEST = (1 << 63) - 1


def usable(vec: Column) -> Column:
    """Whether a vector is known and all its components are known and finite (also after scaling)."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * float(SCALE) < float("inf")))
    return vec.isNotNull() & F.coalesce(good, F.lit(False))


def _whole(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers in doubles as int64, or as Python integers where some are large; shorter ones end in zeros."""
    size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    x = np.asarray(lists.flatten(), np.float64)
    large = bool(len(x)) and np.abs(x).max() >= SAFE
    out = np.zeros((len(size), width), object if large else np.int64)
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    out[row, col] = [int(v) for v in x] if large else x.astype(np.int64)
    return out


class Codebooks:
    """For each part the entries, as lists of Python integers."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        self.parts = len(entries)
        self.span = len(entries[0][0])
        self.large = any(abs(v) >= SAFE for part in entries for e in part for v in e)

    @property
    def width(self) -> int:
        return self.parts * self.span

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For every row and part the index of the nearest entry and its distance, and how many distances were evaluated
        exactly."""
        n = len(x)
        index = np.zeros((n, self.parts), np.int64)
        exact = x.dtype == object or self.large or self.width > 1 << 17
        error = np.zeros((n, self.parts), object if exact else np.int64)
        looked = 0
        for p, part in enumerate(self.entries):
            c, own = np.array(part, object if exact else np.int64), x[:, p * self.span : (p + 1) * self.span]
            for at in range(0, n, TILE):
                tile = own[at : at + TILE]
                d, k = (_all(tile.astype(object), c), len(c) * len(tile)) if exact else _screened(tile, c)
                best = d.argmin(axis=1)  # the first of equals
                index[at : at + TILE, p], error[at : at + TILE, p] = best, d[np.arange(len(tile)), best]
                looked += k
        return index, error, looked


def _all(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.stack([((x - e) ** 2).sum(axis=1) for e in c], axis=1)


def _screened(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """Exact distances of entries whose interval overlaps the best one's, LONGEST for the others; and their number."""
    a, b = x.astype(np.float32), c.astype(np.float32)
    # |x|^2 is the same for all entries of a row and is left out
    rough = (c.astype(np.float64) ** 2).sum(axis=1)[None, :] - 2.0 * (a @ b.T).astype(np.float64)
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))[None, :]
    # doubled for the factor of two; the last term covers the roundings of the double arithmetic above
    off = 2.0 * (x.shape[1] + 4) * 2.0**-24 * length * 1.0001 + 2.0**-48 * (np.abs(rough) + length) + 1e-9
    row, entry = np.nonzero(rough - off <= (rough + off).min(axis=1)[:, None])
    out = np.full(rough.shape, LONGEST, np.int64)
    out[row, entry] = ((x[row] - c[entry]) ** 2).sum(axis=1)
    return out, len(row)


def _sums(held) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = held.value
        total: dict[tuple[int, int], list] = {}
        for b in trimmed(batches):
            x = _whole(b.column(0), books.width)
            index, _, _ = books.nearest(x)
            for p in range(books.parts):
                own = x[:, p * books.span : (p + 1) * books.span]
                for e in np.unique(index[:, p]).tolist():
                    rows = own[index[:, p] == e]
                    held_sum = total.setdefault((p, e), [0, [0] * books.span])
                    held_sum[0] += len(rows)
                    held_sum[1] = [s + int(v) for s, v in zip(held_sum[1], rows.sum(axis=0))]
        rows = [(p, e, i, str(v), n) for (p, e), (n, s) in sorted(total.items()) for i, v in enumerate(s)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        cols = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "entry", "place", "total", "n"])

    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of a table (id, vec) of integer vectors (arrays of double that hold integers). Starts from the vectors of
    the smallest ids (null ids last, equal ids by their vectors); without vectors there are no codebooks."""
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("vec"))).first()[0]
    if width is None:
        return None
    span = max(1, -(-width // parts))
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    start = [[int(v) for v in r["vec"]] + [0] * (span * parts - len(r["vec"])) for r in first]
    books = Codebooks([[v[p * span : (p + 1) * span] for v in start] for p in range(parts)])
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)
        found = vectors.select("vec").mapInArrow(_sums(held), "part int, entry int, place int, total string, n long")
        found = found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        new = [[list(e) for e in part] for part in books.entries]
        for r in found:
            new[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
        books = Codebooks(new)
        held.destroy()
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, code (two hex digits a part) and error of a table (id, vec, label)."""
    held = vectors.sparkSession.sparkContext.broadcast(books)
    rows = vectors.select("id", "label", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for b in trimmed(batches):
            index, error, _ = books.nearest(_whole(b.column(2), books.width))
            code = [bytes(r).hex() for r in index.astype(np.uint8)]
            sums = [min(int(v), LONGEST) for v in error.sum(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(sums, pa.int64())], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, rows.drop("vec").schema.add("code", "string").add("error", "long"))


def compress(vectors: DataFrame, work: Work, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of a table (vec_id, embedding, label); other columns aren't read.

    Vectors that are null or hold null or non-finite components (or such as overflow a double when scaled) are left out. Vectors of several lengths count as ended
    by zeros, and so does a length that isn't a multiple of `parts`; with fewer vectors than `entries` there are as many
    entries as vectors. Repeated rows and ids are coded each, a null id too (it starts a codebook last). An empty table
    gives an empty one. `entries` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    whole = F.transform("embedding", _floored)
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), whole.alias("vec"), F.col("label").alias("label"))
    rows = work.save(rows, "vectors")
    books = train(rows.select("id", "vec"), parts, entries, rounds)
    if books is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = work.save(encode(rows, books), "coded")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    label_error = F.least(F.col("sum"), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    # few labels or many, one of them on most rows: both sides are dealt by the label, and AQE splits the large one
    out = coded.join(by_label.hint("merge"), coded["label"].eqNullSafe(by_label["of"]), "left")
    return out.select(F.col("id").alias("vec_id"), "code", "error", label_error.alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))


def _floored(x: Column) -> Column:
    """floor(SCALE * x) as a double: Spark's floor of a double is a long, which large values don't fit."""
    y = x.cast("double") * F.lit(float(SCALE))
    return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"), Work(spark, "codes"))


def _sql() -> str:
    """Rounds written out; distances in DuckDB's huge integers."""
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS MATERIALIZED (
  SELECT vec_id, r, part, c[part * w + 1 : part * w + w] AS x FROM (SELECT *, len(c) // {PARTS} AS w FROM v), range({PARTS}) t(part)
), b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {ENTRIES})"""
    ]
    distance = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT p.r, p.part, arg_min(b.entry, (CAST({distance} AS HUGEINT), b.entry)) AS entry, min(CAST({distance} AS HUGEINT)) AS d
  FROM p JOIN b{i} b ON b.part = p.part GROUP BY p.r, p.part)""")
        if i < ROUNDS:
            steps.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN (
    SELECT part, entry, list(m ORDER BY place) AS c FROM (
      SELECT p.part, a.entry, place, CAST(floor(sum(p.x[place]) / count(*)) AS BIGINT) AS m
      FROM p JOIN a{i} a ON a.r = p.r AND a.part = p.part, range(1, len(p.x) + 1) t(place) GROUP BY 1, 2, 3) GROUP BY 1, 2
  ) n ON n.part = b.part AND n.entry = b.entry)""")
    return ", ".join(steps) + f""", e AS (
  SELECT r, string_agg(lpad(to_hex(CAST(entry AS BIGINT)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r
), l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM e JOIN v USING (r) GROUP BY label)
SELECT v.vec_id, lower(e.code) AS code, e.error, l.label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
FROM v JOIN e USING (r) JOIN l ON l.label IS NOT DISTINCT FROM v.label"""


OP11_SQL = _sql()
