"""Statistics of neighbourhoods, projections, boxes and walls."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wall(df: DataFrame, count: str, radius: str, voxel: float, step: float) -> DataFrame:
    """area of a wall's cross-section from a voxel count, outer_radius of lumen and wall together, and thickness."""
    d = df.withColumn("area", F.col(count) * voxel / step)
    d = d.withColumn("outer_radius", F.sqrt(F.col("area") / math.pi + F.col(radius) * F.col(radius)))
    return d.withColumn("thickness", F.col("outer_radius") - F.col(radius))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, population sd, least, most, exact p5 and p95, and mean -/+ 2 sd."""
    d = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.percentile(value, 0.05).alias("p5"), F.percentile(value, 0.95).alias("p95"),
    )
    return d.withColumn("low", F.col("mean") - 2 * F.col("sd")).withColumn("high", F.col("mean") + 2 * F.col("sd"))


def project(df: DataFrame, keep: list[str], value: str) -> DataFrame:
    """Mean, maximum and minimum along the axes that aren't kept."""
    return df.groupBy(*keep).agg(F.avg(value).alias("mean"), F.max(value).alias("most"), F.min(value).alias("least"))


def bounding_box(df: DataFrame, by: list[str], axes: str) -> DataFrame:
    """Least, most and centre of each axis."""
    ends = [f(c).alias(f"{n}_{c}") for c in axes for f, n in ((F.min, "low"), (F.max, "high"))]
    d = df.groupBy(*by).agg(*ends)
    return d.withColumns({f"mid_{c}": (F.col(f"low_{c}") + F.col(f"high_{c}")) / 2 for c in axes})


def station_summary(df: DataFrame, by: list[str], s: str, thickness: str, radius: str, closed: str, limit: float, step: float, worth: float | None = None) -> DataFrame:
    """Length over the limit (strictly), most thickness and where, least open diameter and where, closed length. Of equals
    the first station wins; a closed station has no open diameter. With `worth`, where the most and the least are is weighed
    against the way there: it is at the most thickness * worth - s, and at the least open radius * worth + s."""
    t, r, at = F.col(thickness), F.col(radius), F.col(s)
    high, low = (t, r) if worth is None else (t * worth - at, r * worth + at)
    d = df.groupBy(*by).agg(
        (F.count_if(t > limit) * step).alias("length_over"), F.max(t).alias("thickest"), F.max(F.when(high.isNotNull(), F.struct(high.alias("w"), (-at).alias("s")))).alias("m"),
        F.min(F.when(~F.col(closed), r)).alias("o"), F.min(F.when(~F.col(closed) & low.isNotNull(), F.struct(low.alias("w"), at.alias("s")))).alias("n"),
        (F.count_if(closed) * step).alias("closed_length"), F.median(F.when(t > limit, t)).alias("median_over"),
    )
    return d.select(*by, "length_over", "thickest", (-F.col("m.s")).alias("thickest_at"), (2 * F.col("o")).alias("narrowest"), F.col("n.s").alias("narrowest_at"), "closed_length", "median_over")
