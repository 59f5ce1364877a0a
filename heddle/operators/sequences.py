"""Windows over ordered points: arc length, smoothing, runs, gaps, resampling.

Every function takes the group's columns `by` and a total order, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: str, order: list[str]) -> WindowSpec:
    return Window.partitionBy(by).orderBy(*order)


def distance(columns: list[str], w: WindowSpec, back: int = 1) -> Column:
    """From the row before, null at the first."""
    return F.sqrt(sum((F.pow(F.col(c) - F.lag(c, back).over(w), F.lit(2)) for c in columns[1:]), F.pow(F.col(columns[0]) - F.lag(columns[0], back).over(w), F.lit(2))))


def arc_length(df: DataFrame, by: str, order: list[str], point: list[str], out: str = "s") -> DataFrame:
    """Length along the path, 0 at its first point."""
    w = ordered(by, order)
    d = df.withColumn("__d", F.coalesce(distance(point, w), F.lit(0.0)))
    return d.withColumn(out, F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def moving_average(c: str, by: str, order: list[str], width: int) -> Column:
    """Centred mean, cut short at the ends; an even width acts as the next odd one. Groups under three rows, and widths up to 1, stay."""
    if width <= 1:
        return F.col(c)
    w, h = ordered(by, order), width // 2
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return F.when(n < 3, F.col(c)).otherwise(F.avg(c).over(w.rowsBetween(-h, h)))


def smooth(df: DataFrame, c: str, by: str, order: list[str], passes: int = 1) -> DataFrame:
    """Passes of (before + 2 own + after) / 4; the ends stay."""
    w = ordered(by, order)
    for _ in range(passes):
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        df = df.withColumn(c, F.when(before.isNull() | after.isNull(), F.col(c)).otherwise((before + 2 * F.col(c) + after) / 4))
    return df


def tangents(point: list[str], by: str, order: list[str]) -> list[Column]:
    """Unit central differences, one-sided at the ends; the last axis for a lone point."""
    w = ordered(by, order)
    lead = [F.coalesce(F.lead(c).over(w), F.col(c)) for c in point]
    lag = [F.coalesce(F.lag(c).over(w), F.col(c)) for c in point]
    half = F.when(F.lead(point[0]).over(w).isNull() | F.lag(point[0]).over(w).isNull(), 1.0).otherwise(2.0)
    d = [(a - b) / half for a, b in zip(lead, lag)]
    size = F.greatest(F.sqrt(sum((F.pow(x, F.lit(2)) for x in d[1:]), F.pow(d[0], F.lit(2)))), F.lit(1e-9))
    alone = F.count(F.lit(1)).over(Window.partitionBy(by)) == 1
    return [F.when(alone, F.lit(1.0 if i == len(d) - 1 else 0.0)).otherwise(x / size) for i, x in enumerate(d)]


def runs(df: DataFrame, by: str, order: list[str], flag: Column) -> DataFrame:
    """First and last place (from 0) of every run of true, and its number of rows."""
    w = ordered(by, order)
    d = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__n", F.row_number().over(w) - 1)
    d = d.withColumn("__k", F.row_number().over(Window.partitionBy(by, "__f").orderBy(*order)))
    d = d.where("__f").groupBy(by, (F.col("__n") - F.col("__k")).alias("__g"))
    return d.agg(F.min("__n").alias("first"), F.max("__n").alias("last"), F.count(F.lit(1)).alias("rows")).drop("__g")


def longest_run(df: DataFrame, by: str, order: list[str], flag: Column) -> DataFrame:
    """The run with most rows; of equals the later one."""
    return runs(df, by, order, flag).groupBy(by).agg(F.max(F.struct("rows", "first", "last")).alias("r")).select(by, "r.rows", "r.first", "r.last")


def fill(c: str, at: str, by: str, order: list[str]) -> Column:
    """Linear interpolation over nulls along `at`; outside the known rows the nearest known value."""
    w = ordered(by, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(c).isNotNull(), F.col(at))
    v0, v1 = F.last(c, True).over(back), F.first(c, True).over(ahead)
    t0, t1 = F.last(known, True).over(back), F.first(known, True).over(ahead)
    return F.coalesce(F.col(c), F.when(v0.isNull(), v1).when(v1.isNull(), v0).when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (F.col(at) - t0) / (t1 - t0)))


def resample(df: DataFrame, by: str, at: str, value: str, tiny: float = 1e-6) -> DataFrame:
    """Values at the median step from a group's first place to its last: by, k, at, value.

    Places must differ within a group. The targets join the pieces that they fall in through their group, and only the
    piece around a target is kept: pieces are explored from their own first target to their last.
    """
    w = Window.partitionBy(by).orderBy(at)
    d = df.select(by, at, value, F.lead(at).over(w).alias("__b"), F.lead(value).over(w).alias("__w"))
    step = d.groupBy(by).agg(F.median(F.col("__b") - F.col(at)).alias("__step"), F.min(at).alias("__low"), F.max(at).alias("__high"))
    j = d.join(step, by).where("__step > 0")
    most = F.floor((F.col("__high") - F.col("__low")) / F.col("__step") + tiny)
    k0 = F.ceil((F.col(at) - F.col("__low")) / F.col("__step") - 1e-12)
    k1 = F.coalesce(F.ceil((F.col("__b") - F.col("__low")) / F.col("__step") - 1e-12) - 1, most)
    j = j.withColumn("k", F.explode(F.when(F.least(k1, most) >= k0, F.sequence(k0, F.least(k1, most))).otherwise(F.array().cast("array<bigint>"))))
    place = F.col("__low") + F.col("__step") * F.col("k")
    share = F.when(F.col("__b").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (place - F.col(at)) / (F.col("__b") - F.col(at)))))
    return j.select(by, "k", place.alias("__at"), (F.col(value) * (1 - share) + F.coalesce(F.col("__w"), F.lit(0.0)) * share).alias("__v")).toDF(by, "k", at, value)


def sub_path(df: DataFrame, by: str, s: str, value: str, s0: float, s1: float) -> DataFrame:
    """The points strictly between two lengths and an interpolated point at either end; both ends are held to the path."""
    w = Window.partitionBy(by).orderBy(s)
    every = Window.partitionBy(by)
    d = df.select(by, s, value, F.lead(s).over(w).alias("__b"), F.lead(value).over(w).alias("__w"), F.greatest(F.lit(s0), F.min(s).over(every)).alias("__0"), F.least(F.lit(s1), F.max(s).over(every)).alias("__1"))
    d = d.where("__1 > __0")
    inside = d.where((F.col(s) > F.col("__0")) & (F.col(s) < F.col("__1"))).select(by, s, value)
    ends = []
    for e in ("__0", "__1"):
        hit = d.where((F.col(s) <= F.col(e)) & ((F.col("__b") > F.col(e)) | (F.col("__b").isNull() & (F.col(s) == F.col(e)))))
        at = F.when(F.col("__b").isNull(), F.col(value)).otherwise(F.col(value) + (F.col("__w") - F.col(value)) * (F.col(e) - F.col(s)) / (F.col("__b") - F.col(s)))
        ends.append(hit.select(by, F.col(e).alias(s), at.alias(value)))
    return inside.unionByName(ends[0]).unionByName(ends[1])


def run_length(df: DataFrame, by: str, order: list[str], s: str, flag: Column) -> DataFrame:
    """Length of every run along s: each point counts half the way to either neighbour."""
    w = ordered(by, order)
    d = df.withColumn("__n", F.row_number().over(w) - 1)
    d = d.withColumn("__a", (F.col(s) + F.coalesce(F.lag(s).over(w), F.col(s))) / 2).withColumn("__b", (F.col(s) + F.coalesce(F.lead(s).over(w), F.col(s))) / 2)
    r = runs(df, by, order, flag)
    low = d.select(F.col(by).alias("__x"), F.col("__n").alias("first"), "__a")
    high = d.select(F.col(by).alias("__y"), F.col("__n").alias("last"), "__b")
    j = r.join(low.withColumnRenamed("__x", by), [by, "first"]).join(high.withColumnRenamed("__y", by), [by, "last"])
    return j.select(by, "first", "last", (F.col("__b") - F.col("__a")).alias("length"))
