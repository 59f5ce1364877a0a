"""Cutting lineage in loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .work import shared_root


def cut(df: DataFrame, *by: str) -> DataFrame:
    """The rows of df, written to the shared folder (see work.shared_root) and read again, so that a loop's plan starts anew and survives a lost executor. Deleted when the JVM ends.
    With columns `by` a folder for each of their values, so that a filter on them reads no others; they come last."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
