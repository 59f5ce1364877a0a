"""Exact top-k search by inner product: the three-phase uniform threshold.

A vector's dimensions fall in slices, and a slice's part of the inner product is a local score. For each block of
queries (a block is bounded, and broadcast):

1. gather: each task takes every slice's k highest local scores, resolves those few vectors, and keeps its k best; the
   k-th best over all tasks is a cutoff that no answer lies below. Each slice's lowest local score is kept too.
2. collect: with m slices and local scores counted from the slice's lowest, a vector whose every local score is below
   an m-th of the cutoff is below the cutoff. The rest are collected, and those whose upper bound (the sum of the local
   scores at or over the threshold, and the threshold for others) is below the cutoff go.
3. resolve: remaining vectors get their exact scores; those at or over the cutoff, k at most from a task, are merged.

A row holds all slices of its vector, so phases 2 and 3 happen in one visit and only scores near the cutoff move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import Work, table

K = 10
SLICES = 4
#: Queries in a block, and so the bound of what is broadcast: BLOCK vectors and, of each, a cutoff and SLICES minima.
BLOCK = 1024
TILE = 1024
SCALE = 1024
#: Products and sums below this are exact in a double.
EXACT = 2.0**53


def scaled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer components (as doubles, or Python integers where doubles can't hold them) of a batch's usable rows."""
    ids, lists = batch.column(0), batch.column(1)
    rows = [i for i, ok in enumerate(np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())) if ok]
    if not rows:
        return np.empty(0, np.int64), np.empty((0, 0))
    ids, lists = ids.take(pa.array(rows)), lists.take(pa.array(rows))
    flat = lists.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    size = np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(len(rows)), size)
    good = np.ones(len(rows), bool)
    good[row[~np.isfinite(x)]] = False
    width = int(size.max()) if len(size) else 0
    out = np.zeros((len(rows), width))
    col = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="raise", invalid="ignore"):
        out[row, col] = np.floor(SCALE * np.where(np.isfinite(x), x, 0.0))
    out = out[good]
    if out.size and np.abs(out).max() >= 2.0**24:
        out = np.array([[int(v) for v in r] for r in out], dtype=object).reshape(out.shape)
    return np.asarray(ids)[good], out


def _fit(a: np.ndarray, width: int) -> np.ndarray:
    """Shorter vectors count as filled with zeros."""
    if a.shape[1] >= width:
        return a
    return np.concatenate([a, np.zeros((a.shape[0], width - a.shape[1]), a.dtype)], axis=1)


def _pair(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(q.shape[1], x.shape[1])
    q, x = _fit(q, width), _fit(x, width)
    if object in (q.dtype, x.dtype) or q.size and x.size and np.abs(q).max() * np.abs(x).max() * width >= EXACT:
        whole = lambda a: a if a.dtype == object else np.array([[int(v) for v in r] for r in a], dtype=object).reshape(a.shape)
        q, x = whole(q), whole(x)
    return q, x


def _slices(width: int, m: int) -> list[slice]:
    cuts = [width * i // m for i in range(m + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


class _Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        for i, v, s in zip(q.tolist(), ids.tolist(), scores.tolist()):
            self.rows[i].append((-int(s), v))
        for i in np.unique(q).tolist():
            if len(self.rows[i]) > self.k:
                self.rows[i] = sorted(self.rows[i])[: self.k]

    def batch(self, query_ids: np.ndarray) -> list[tuple[int, int, int]]:
        return [(int(query_ids[i]), v, -s) for i, r in enumerate(self.rows) for s, v in r]


def _gather(held, k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q0 = held.value
        best, lows = _Best(len(qids), k), None
        for b in batches:
            ids, x0 = scaled(b)
            for at in range(0, len(ids), TILE):
                v = ids[at : at + TILE]
                q, x = _pair(q0, x0[at : at + TILE])
                own = qids[:, None] == v[None, :]
                seeds = np.zeros(own.shape, bool)
                low = np.empty((len(qids), m), object)
                for s, cut in enumerate(_slices(q.shape[1], m)):
                    part = np.where(own, -np.inf, (q[:, cut] @ x[:, cut].T).astype(np.float64))
                    top = np.argpartition(-part, min(k, part.shape[1]) - 1, axis=1)[:, :k]
                    np.put_along_axis(seeds, top, True, axis=1)
                    low[:, s] = np.floor(np.where(own, np.inf, part).min(axis=1))
                lows = low if lows is None else np.minimum(lows, low)
                i, j = np.nonzero(seeds & ~own)
                best.add(i, v[j], (q[i] * x[j]).sum(axis=1))
        rows = [(a, 0, b, c, None) for a, b, c in best.batch(qids)]
        if lows is not None:
            rows += [(int(a), 1, None, None, [float(y) for y in r]) for a, r in zip(qids, lows)]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())))], ["query_id", "kind", "vec_id", "score", "lows"])

    return run


def _resolve(held, cutoffs, k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q0 = held.value
        tau, lows = cutoffs.value
        best = _Best(len(qids), k)
        # a slice's share of the cutoff, rounded down (by a further unit beyond exact doubles): a weaker bound is still safe
        share = np.floor((tau - lows.sum(axis=1)) / m)
        share = np.where(np.abs(share) >= 2.0**50, share - np.abs(share) * 2.0**-40, share)
        for b in batches:
            ids, x0 = scaled(b)
            for at in range(0, len(ids), TILE):
                v = ids[at : at + TILE]
                q, x = _pair(q0, x0[at : at + TILE])
                upper, any_over = np.zeros((len(qids), len(v))), np.zeros((len(qids), len(v)), bool)
                for s, cut in enumerate(_slices(q.shape[1], m)):
                    part = (q[:, cut] @ x[:, cut].T).astype(np.float64)
                    limit = (lows[:, s] + share)[:, None]
                    any_over |= part >= limit
                    upper += np.maximum(part, limit)
                slack = np.where(np.abs(upper) >= 2.0**50, np.abs(upper) * 2.0**-40, 0.0)
                i, j = np.nonzero(any_over & (upper + slack >= tau[:, None]) & (qids[:, None] != v[None, :]))
                exact = (q[i] * x[j]).sum(axis=1)
                keep = np.asarray([s >= t for s, t in zip(exact, tau[i])], bool) if exact.dtype == object else exact >= tau[i]
                best.add(i[keep], v[j[keep]], exact[keep])
        cols = list(zip(*best.batch(qids))) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def topk(vectors: DataFrame, queries: DataFrame, k: int = K, slices: int = SLICES, block: int = BLOCK) -> DataFrame:
    """The k highest integer inner products of each query with all other rows: query_id, rank, vec_id, score.

    vectors: id, vec (array of numbers); queries: the same columns. A component x counts as floor(1024 * x). Rows whose
    id or vector is null, or whose vector holds null or a non-finite number, take no part; a shorter vector counts as
    filled up with zeros. Ties go to the smaller id. A query id that repeats counts once (its smallest vector); rows of
    vectors that repeat an id are candidates each; rows with the query's id are its own. Fewer candidates than k: all
    of them. A score beyond a long raises an error. Queries are read a block at a time in id order.
    """
    spark, work = vectors.sparkSession, Work(vectors.sparkSession, "topk")
    sc = spark.sparkContext
    vectors = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").alias("vec"))
    usable = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    asked = work.save(queries.where(F.col("id").isNotNull() & usable).groupBy(F.col("id").cast("long").alias("id")).agg(F.min("vec").alias("vec")), "queries")
    parts, last = [], None
    while True:
        rest = asked if last is None else asked.where(F.col("id") > last)
        held = rest.orderBy("id").limit(block).toArrow()
        if not held.num_rows:
            break
        qids, q = scaled(held.combine_chunks().to_batches()[0])
        last = int(qids.max())
        known = sc.broadcast((qids, q))
        seeds = work.save(vectors.mapInArrow(_gather(known, k, slices), "query_id long, kind int, vec_id long, score long, lows array<double>"), "seeds")
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = {r[0]: r[1] for r in seeds.where("kind = 0").withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select("query_id", "score").collect()}
        least = [F.min(F.element_at("lows", s + 1)).alias(f"l{s}") for s in range(slices)]
        low = {r[0]: r[1:] for r in seeds.where("kind = 1").groupBy("query_id").agg(*least).collect()}
        tau = np.array([kth.get(int(i), -(2.0**62)) for i in qids], np.float64)
        tau = np.where(np.abs(tau) >= EXACT, tau - np.abs(tau) * 2.0**-40, tau)
        lows = np.array([low.get(int(i), (0.0,) * slices) for i in qids], np.float64).reshape(len(qids), slices)
        lows = np.where(np.isfinite(lows), lows, 0.0)
        parts.append(work.save(vectors.mapInArrow(_resolve(known, sc.broadcast((tau, lows)), k, slices), "query_id long, vec_id long, score long"), "found"))
        work.drop(seeds)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return topk(vectors, vectors.where("id % 100 = 0"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.c), len(v.c)) + 1), lambda i: q.c[i] * v.c[i])), 0) AS BIGINT) AS score
  FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""
