"""Sinks that a failure leaves as they were: versions of a table with commit markers, and folders that are swapped whole."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """The numbers that names in a folder end in, after a prefix, in order."""
    return sorted(int(x[len(prefix) :]) for x in _names(spark, path) if x.startswith(prefix) and x[len(prefix) :].isdigit())


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Versions:
    """A table whose every write is a version of its own under one path.

    A writer claims the next number by making a file that must not exist yet, so two writers never share one; it writes
    data/NUMBER, and only when that is whole makes commits/NUMBER. Readers take the largest committed number, so they see
    one version or the next, never a part, and a write that fails changes nothing. Of two writers at once the one with the
    larger number is what is read, whichever ends first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _make(self, name: str) -> bool:
        """Makes an empty file; false if it is there already. One of several writers makes it."""
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        fs.mkdirs(p.getParent())
        if fs.getScheme() == "file":  # Hadoop's own looks first and makes it then
            return self.spark._jvm.java.io.File(p.toUri().getPath()).createNewFile()
        try:
            return fs.createNewFile(p)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False

    def _numbers(self, folder: str) -> list[int]:
        return numbers(self.spark, f"{self.path}/{folder}")

    def claim(self) -> int:
        n = max(self._numbers("claims"), default=0) + 1
        while not self._make(f"claims/{n:010}"):
            n += 1
        return n

    def write(self, df: DataFrame) -> int:
        """The number of the version that was written."""
        n = self.claim()
        df.write.parquet(f"{self.path}/data/{n:010}")
        if not self._make(f"commits/{n:010}"):
            raise ValueError(f"version {n} was committed by another writer")
        return n

    def versions(self) -> list[int]:
        return self._numbers("commits")

    def read(self, version: int | None = None) -> DataFrame:
        """A committed version, the last by default; none is an error."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ValueError(f"{self.path} has no version {'' if version is None else version}".rstrip())
        return self.spark.read.parquet(f"{self.path}/data/{known[-1] if version is None else version:010}")

    def forget(self, keep: int = 2) -> None:
        """Deletes committed versions but the last `keep`, and what failed writes before them have left. The numbers' claims
        stay, so that none is given twice."""
        if keep < 1:
            raise ValueError("the last version stays")
        known = self.versions()
        least = known[-keep] if len(known) >= keep else known[0] if known else 0
        for n in self._numbers("data"):
            if n < least:
                for folder in ("commits", "data"):  # no longer read before it goes
                    delete(self.spark, f"{self.path}/{folder}/{n:010}")


def swapped(spark: SparkSession, path: str, write, replace: bool = True) -> None:
    """write(folder beside path), then that folder takes path's place. A write that fails leaves path as it was, and nothing
    beside it; without `replace` a path that is there is an error. Between two renames path may be missing for a moment."""
    path = path.rstrip("/")
    fs, at = _fs(spark, path)
    if not replace and fs.exists(at):
        raise FileExistsError(path)
    mark = uuid.uuid4().hex
    _, new = _fs(spark, f"{path}.{mark}.new")
    _, old = _fs(spark, f"{path}.{mark}.old")
    try:
        write(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        fs.delete(new, True)
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        fs.delete(new, True)
        raise OSError(f"{path} can't be put in place")
    if had:
        fs.delete(old, True)
