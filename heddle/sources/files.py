"""File scans: JSON lines that skip broken rows, JSON documents, binary scenes, newest files, paged services."""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from heddle.lineage import cut
from heddle.sources.sinks import swapped

# Endings that a folder scan leaves out.
SKIPPED = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".pdf", ".txt", ".htm", ".html", ".xml",
    ".js", ".css", ".exe", ".dll", ".inf", ".ini", ".ico", ".json", ".md", ".csv",
    ".zip", ".cab", ".msi", ".bat", ".cmd", ".sys", ".db", ".lnk", ".url", ".plist",
)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One document for each file, a byte order mark and CRLF line ends taken away; null where it is malformed."""
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n", "\n")
    return spark.read.text(path, wholetext=True).select(F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("doc"))


def folder(spark: SparkSession, path: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path, modificationTime, length of a folder's files at any depth, without those of skipped endings. Content isn't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return d.where(~F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in skipped) + ")$")) if skipped else d


def newest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The file with the latest modification time; of equals the greatest path."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return d.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def glb_json(raw: bytes) -> str:
    """The JSON chunk of a binary scene, version 2."""
    magic, version, _ = struct.unpack_from("<4sII", raw)
    if magic != b"glTF" or version != 2:
        raise ValueError("not a version 2 binary scene")
    size, kind = struct.unpack_from("<I4s", raw, 12)
    if kind != b"JSON":
        raise ValueError("the first chunk isn't JSON")
    return raw[20 : 20 + size].decode("utf-8")


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """path, json of binary scenes; an unreadable file's json is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                try:
                    out.append(glb_json(raw))
                except (ValueError, struct.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "json"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, json string")


def retried(get: Callable[[], dict], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> dict:
    """get(), up to so many times while it raises OSError, waiting 1, 2, 4, ... seconds between."""
    for n in range(attempts):
        try:
            return get()
        except OSError:
            if n == attempts - 1:
                raise
            wait(2**n)
    raise ValueError("no attempts")


class Pages(DataSource):
    """A paged service as a batch source: option `pages` names a function 'module:name' of (token) that returns a dict with
    `rows` and `next`. Tokens chain, so there is one partition; option `most` bounds the pages. Columns: position, row (JSON),
    and truncated, false but for a last row without content that stands for pages beyond `most`; see paged()."""

    @classmethod
    def name(cls) -> str:
        return "heddle_pages"

    def schema(self) -> str:
        return "position long, row string, truncated boolean"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagesReader(self.options)


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.target, self.most = options["pages"], int(options.get("most", 5))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, name = self.target.split(":")
        get, token, position = getattr(importlib.import_module(module), name), None, 0
        for _ in range(self.most):
            page = retried(lambda token=token: get(token))
            for row in page.get("rows", []):
                yield position, json.dumps(row), False
                position += 1
            token = page.get("next")
            if not token:
                return
        yield position, None, True


def paged(spark: SparkSession, pages: str, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """The rows of a paged service (position, row), and one row that says whether there were more pages (truncated). The
    service is read once, into the shared folder; rows and flag are parts of what was read."""
    spark.dataSource.register(Pages)
    d = cut(spark.read.format("heddle_pages").option("pages", pages).option("most", most).load())
    return d.where("not truncated").select("position", "row"), d.agg(F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated"))


def numbered_names(existing: DataFrame, new: DataFrame, order: list[str], stem: str) -> DataFrame:
    """new with a file name each, numbered on from the highest number that `existing` (name) has, so nothing is overwritten."""
    from heddle.work import Work, ranked

    top = existing.agg(F.coalesce(F.max(F.regexp_extract("name", rf"^{stem}-(\d+)", 1).try_cast("int")), F.lit(0)).alias("__top"))
    return ranked(Work(new.sparkSession, "names"), new, [], order, "__n", nulls_last=False).join(F.broadcast(top)).withColumn("name", F.format_string(stem + "-%04d", F.col("__n") + F.col("__top"))).drop("__n", "__top")


def save_json(df: DataFrame, path: str, replace: bool = True) -> None:
    """Rows as JSON lines in a folder: written beside it, then put in its place, so that a failed write leaves the old rows;
    without `replace` an existing one is an error. For readers beside writers see sinks.Versions."""
    swapped(df.sparkSession, path, df.write.json, replace)


def save_masks(masks: DataFrame, path: str) -> None:
    """Voxels of masks (structure, and their places), a folder for each structure. Rows are dealt by structure and a part of
    their hash, so a large structure is written by several tasks and a small one in few files."""
    parts = F.pmod(F.xxhash64(*[c for c in masks.columns if c != "structure"]), F.lit(8))
    masks.repartition("structure", parts).write.partitionBy("structure").mode("overwrite").parquet(path)


def masks(spark: SparkSession, path: str, structures: list[str] | None = None) -> DataFrame:
    """The masks of an archive; of named structures only their folders are read."""
    d = spark.read.option("recursiveFileLookup", False).parquet(path).withColumn("structure", F.col("structure").cast("string"))
    return d if structures is None else d.where(F.col("structure").isin(structures))
