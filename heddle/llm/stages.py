"""The operators as stages of a pipeline: each takes and returns a table with the columns of documents.

All columns, whatever their names, come back as they were, but for text and n_chars where a stage cuts the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, near, packing, spans, toxicity
from .work import Work, ranked, spare, table
from .worker import only, trimmed


def numbered(work: Work, docs: DataFrame, name: str) -> DataFrame:
    """docs with column `name`, different in every row and in order of doc_id: doc_id itself if it is known and different
    everywhere, else the rank by (doc_id, text), null ids last, equal rows in the order they are read in."""
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    same = ids.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("i is null or n > 1")
    if same.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return ranked(work, docs, [], ["doc_id", "text"], name)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the toxicity operator rejects (score 0.5 or more). A null text is scored as an empty one,
    and stays or goes with it. Repeated rows are scored each; without labels of both classes all of a table stay, or go."""
    work = Work(spark, "stage-toxicity")
    held = spark.sparkContext.broadcast(toxicity.fit(docs, table(spark, sf_dir, "labels"), work))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        index = held.value
        for b in trimmed(batches):
            yield b.filter(pa.array([p < 0.5 for p, _ in index.scores(b.column(at).cast(pa.string()))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingle sets alike by 0.8 or more) the document with the smallest doc_id stays.

    The pairs are found by the SimHash operator's bit-sliced comparison and decided by the sets; see near. Texts without
    words (null, empty) are copies of each other. Rows that repeat an id, or have none, are documents each."""
    work = Work(spark, "stage-simhash")
    row = spare("row", docs.columns)
    known, own = numbered(work, docs, row), Work(spark, "near")
    kept = work.save(near.kept(known, row, own).select(F.col("id").alias(row)), "kept")
    own.close()
    return known.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of spans that an earlier document, or an earlier place, has. Rows without doc_id, or that
    share one, are documents of their own, in order of (doc_id, text). Null texts stay null; an empty table stays empty."""
    work = Work(spark, "stage-spans")
    row = spare("row", docs.columns)
    known = numbered(work, docs, row)
    rest = [c for c in docs.columns if c != "text"]
    packed = known.select(F.col(row).alias("id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias(spare("none", rest)), *[known[c] for c in rest]).alias("row"))
    cut = spans.dedup(packed, work)
    own = {c: F.col("row").getField(c) for c in rest} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("removed") > 0, F.length("text")).otherwise(own["n_chars"])
    return cut.select(*[own[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources emits it. A null text has size 0, a null source is a source; rows that
    repeat an id are documents each; an empty table stays empty."""
    work = Work(spark, "stage-mixing")
    row, times = spare("row", docs.columns), spare("times", docs.columns)
    known = numbered(work, docs, row)
    emitted = mixing.copies(known.select(F.col(row).alias("doc_id"), "text", "source"))
    emitted = work.save(emitted.where("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").cast("int").alias(times)), "emitted")
    out = known.join(emitted.hint("merge"), row)  # at every size the text moves; a broadcast would hold a row for each document
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences; see packing. A null text is an empty document: its end alone."""
    return packing.pack_documents(docs)


