"""Plumbing shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.work import Work, partitions, ranked, shared_root, spare  # noqa: F401

#: ASCII white space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(key: str, seed: int = 0) -> Column:
    """A fixed number in [0, 1) with 24 bits, from the MD5 of a nullable string column; DuckDB can compute the same one."""
    text = F.concat(F.coalesce(F.concat(F.lit("s"), F.col(key)), F.lit("n")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))
