"""The training-text pipeline: toxic documents and near copies go, repeated passages are cut, sources are mixed, and the
rest is packed into sequences. Every stage is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import stages
from heddle.llm.work import Work, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.reject_toxic),
    ("simhash", stages.drop_near_copies),
    ("spans", stages.cut_repeats),
    ("mixing", stages.mix),
    ("packing", stages.pack),
]
#: A vote of nearest examples, majority hashes, star rounds and best-fit packing have no SQL form; tests/llm hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
