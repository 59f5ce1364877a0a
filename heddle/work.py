"""Intermediate tables and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir, or else the context's checkpoint folder.

    Where neither is set a folder of our own is made if all workers are on this machine; on a cluster that would lose
    rows, since executors don't see each other's folders, so it is an error there.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="heddle-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class Work:
    """Written tables that cut lineage: they lie in the shared folder, so a lost executor loses none of them.

    Tables are deleted by drop(), or else when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def _fs(self, path: str):
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(jsc.hadoopConfiguration()), p

    def folder(self, name: str) -> str:
        fs, p = self._fs(f"{self.root}/{name}")
        fs.mkdirs(p)
        _, top = self._fs(self.root)
        fs.deleteOnExit(top)
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{name}-{self._n}"
        df.write.parquet(path)
        fs, top = self._fs(self.root)
        fs.deleteOnExit(top)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._heddle_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            fs, p = self._fs(df._heddle_path)
            fs.delete(p, True)

    def close(self) -> None:
        """Deletes all tables that were saved."""
        fs, top = self._fs(self.root)
        fs.delete(top, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare(name: str, columns: list[str]) -> str:
    """The name, with '_' added while one of the columns has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(work: Work, df: DataFrame, by: list[str], order: list[str], out: str, nulls_last: bool = True) -> DataFrame:
    """df with column out: the row's rank from 1 within the group by, in the given order, nulls last or first, and equal rows
    in the order they are read in.

    No group meets in one task: rows are dealt by range over (by, order, place), each range is ranked by itself, and the
    counts of the ranges before it (a row for each range and group) are added. The place makes all rows different, so that
    many equal ones fall in many ranges. Columns of any name are kept.
    """
    place, pid, rn, n, before, p = (spare(x, [*df.columns, out]) for x in ("place", "range", "row", "n", "before", "p"))
    keys = [spare(f"by{i}", df.columns) for i in range(len(by))]
    up = lambda c: F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first()
    placed = df.withColumn(place, F.monotonically_increasing_id())
    dealt = work.save(placed.repartitionByRange(partitions(work.spark), *[up(c) for c in by + order], place).withColumn(pid, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*by, pid).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*by).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(k) for k, c in zip(keys, by)], F.col(pid).alias(p), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    local = Window.partitionBy(*by, pid).orderBy(*[up(c) for c in order], place)
    rows = dealt.withColumn(rn, F.row_number().over(local))
    on = [rows[pid] == counts[p]] + [rows[c].eqNullSafe(counts[k]) for c, k in zip(by, keys)]
    return rows.join(counts, on, "left").select(*[rows[c] for c in df.columns if c.lower() != out.lower()], (F.col(rn) + F.coalesce(F.col(before), F.lit(0))).cast("long").alias(out))
