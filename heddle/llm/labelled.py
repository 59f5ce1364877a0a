"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Work


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, mod; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(0))


def sample(work: Work, docs: DataFrame, labels: DataFrame, label: str, zeros: int, ones: int, mod: int = 5, out: int = 0) -> tuple[DataFrame, int, int]:
    """id, text, y of at most `zeros` + `ones` labelled documents whose remainder isn't `out`, and how many there are of each.

    The documents with the least hash of their id are taken, so reruns agree. Null labels and ids are left out; an id
    labelled twice counts once, with its largest label; of a repeated document its largest text is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", mod) != out))
    known = work.save(known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y")), "labels")
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id", "left_semi")
    known = work.save(known, "known")
    size = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    first = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    taken = work.save(first(0, zeros).unionByName(first(1, ones)), "taken")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "id")
    texts = texts.groupBy("id", "y").agg(F.max("text").alias("text"))
    return work.save(texts, "sample"), size.get(0, 0), size.get(1, 0)
