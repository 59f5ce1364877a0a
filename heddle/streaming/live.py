"""Structured Streaming forms of the keyed collection, the snapshot, the ingestion cursor and content dedup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from heddle.operators.state import latest
from heddle.sources import sinks


def read(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).parquet(folder)


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A recurring run: everything since the last one, once, then stop. The checkpoint is the cursor, and only advances
    when the batch has been written."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def upsert_to(path: str, keys: list[str], version: list[str], deleted: str, every: int = 20) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a batch's last change of each key to a log of changes in `path`, one folder a batch, so that
    a batch that runs again replaces itself. Read the collection with current().

    After each `every` batches the log is folded into a base of one row a key, a version of its own (sinks.Versions). Folders
    go only when the next base has been written, so who began to read before it finds all that they listed; between `every`
    and twice as many folders stay, at any length of the stream. A key's deletion stays in the base: an older change that
    comes late doesn't bring the key back."""

    def write(batch: DataFrame, number: int) -> None:
        _last(batch, keys, version).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if number % every == every - 1:
            spark = batch.sparkSession
            base = sinks.Versions(spark, f"{path}/base")
            base.write(_last(_log(spark, path, batch.schema), keys, version))
            base.forget(2)
            for n in sinks.numbers(spark, f"{path}/changes", "batch="):
                if n <= number - every:
                    sinks.delete(spark, f"{path}/changes/batch={n}")

    return write


def _last(changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r"))
    return last.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(changes.columns)


def _log(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The last base with all changes that are there. Some may be in both: the last change of a key is the same then."""
    reader = spark.read.option("basePath", f"{path}/changes")
    log = (reader.schema(schema) if schema else reader).parquet(*[f"{path}/changes/batch={n}" for n in sinks.numbers(spark, f"{path}/changes", "batch=")])
    log = log.select([c for c in log.columns if c != "batch"])
    base = sinks.Versions(spark, f"{path}/base")
    return base.read().select(log.columns).unionByName(log) if base.versions() else log


def current(spark: SparkSession, path: str, keys: list[str], version: list[str], deleted: str) -> DataFrame:
    """The collection as of the last batch."""
    return latest(_log(spark, path), keys, version, deleted)


def snapshot_to(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every batch is the whole collection and replaces it; each goes to its own folder, the highest counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def last_snapshot(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("basePath", path).parquet(path)
    top = d.agg(F.max("batch").alias("__b"))
    return d.join(F.broadcast(top), F.col("batch") == F.col("__b"), "left_semi").drop("batch")


def content_dedup(stream: DataFrame, content: str, ts: str, within: str = "1 day") -> DataFrame:
    """Rows whose content hasn't been seen within the time; `ts` must be a timestamp."""
    return stream.withColumn("__h", F.md5(content)).withWatermark(ts, within).dropDuplicatesWithinWatermark(["__h"]).drop("__h")
