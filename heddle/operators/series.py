"""Geometry, gaps and choice among series of ordered positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: positions closer than this are the same.
SAME = 1e-3


def spacing(df: DataFrame, by: str, position: str) -> DataFrame:
    """Per series: n, step (median of true differences), coverage, duplicates, gaps and a verdict.

    A difference up to SAME is a duplicate, over 1.5 steps a gap; spacing is irregular where a true difference is off the
    step by more than 1 % of it and more than 0.02.
    """
    w = Window.partitionBy(by).orderBy(position)
    d = df.select(by, position, (F.col(position) - F.lag(position).over(w)).alias("d"))
    d = d.withColumn("real", F.when(F.col("d") > SAME, F.col("d"))).withColumn("step", F.median("real").over(Window.partitionBy(by)))
    off = F.abs(F.col("real") - F.col("step")) > F.greatest(0.01 * F.col("step"), F.lit(0.02))
    one = d.groupBy(by).agg(
        F.count(position).alias("n"), F.max("step").alias("step"), (F.max(position) - F.min(position)).alias("coverage"), F.count_if(F.col("d") <= SAME).alias("duplicates"),
        F.count_if((F.col("step") > 0) & (F.col("real") > 1.5 * F.col("step"))).cast("int").alias("gaps"), F.bool_or(off).alias("off"),
    )
    # The verdicts' texts.
    verdict = (
        F.when(F.col("n") < 2, "-")
        .when(F.col("duplicates") > 0, F.concat(F.col("duplicates").cast("string"), F.lit(" posiciones repetidas")))
        .when(F.col("gaps") > 0, F.concat(F.lit("irregular ("), F.col("gaps").cast("string"), F.lit(" huecos)")))
        .when(F.col("off"), "irregular")
        .otherwise("uniforme")
    )
    return one.withColumn("verdict", verdict).drop("off")


def mode(df: DataFrame, by: str, value: Column, position: str, out: str = "mode") -> DataFrame:
    """The most frequent value of each group; of equal counts the one seen first, by position, then the smaller."""
    counted = df.select(by, value.alias("v"), position).groupBy(by, "v").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("p"))
    return counted.groupBy(by).agg(F.min_by("v", F.struct(-F.col("n"), "p", "v")).alias(out))


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ascending order (nulls first), as a sum that combines before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r"))).alias("__m"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__m.r.{c}").alias(c) for c in df.columns])


def resolve(rows: DataFrame, by: str, key: str, number: str, index: str, selector: int) -> DataFrame:
    """by, chosen, status of a selector in each group: the row with that number; where none has it, the row with that
    index. More than one match is 'ambiguous' and none 'missing', both without a choice: callers that need one must fail."""
    hit = F.col(number) == selector
    one = rows.groupBy(by).agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col(key))).alias("a"), F.min(F.when(F.col(index) == selector, F.col(key))).alias("b"))
    chosen = F.when(F.col("n") == 1, F.col("a")).when(F.col("n") == 0, F.col("b"))
    return one.select(by, chosen.alias("chosen"), F.when(F.col("n") > 1, "ambiguous").when(chosen.isNull(), "missing").otherwise("found").alias("status"))


def weighting(text: Column, kind: Column, b: Column, te: Column, tr: Column, ti: Column) -> Column:
    """A hint of a series' weighting; rules on text come before rules on numbers."""
    num = lambda c: F.coalesce(c, F.lit(0.0))
    te, tr, ti = num(te), num(tr), num(ti)
    out = F.when(kind.contains("DIFF") | kind.contains("ADC") | text.rlike(r"dwi|diff|\badc\b|trace") | (num(b) != 0), "difusión")
    # Patterns and labels.
    for pattern, label in ((r"flair", "FLAIR"), (r"stir", "STIR"), (r"mrcp|colangio", "T2 intensa (colangio)"), (r"vibe|lava|thrive|\bt1\b|t1w|t1_", "T1"), (r"haste|ssfse|\bt2\b|t2w|t2_", "T2")):
        out = out.when(text.rlike(pattern), label)
    timed = (tr != 0) & (te != 0)
    return (
        out.when(ti > 1500, "FLAIR")
        .when(ti.between(100, 250), "STIR")
        .when(timed & (tr < 1000) & (te < 30), "T1")
        .when(timed & (tr >= 1500) & (te >= 60), "T2")
        .when(timed & (tr >= 1500) & (te < 40), "densidad protónica")
        .otherwise("?")
    )


def orientation(x: Column, y: Column, z: Column) -> Column:
    """The name of the axis that a unit normal is nearest to, as oblique where it is off by more than 0.97."""
    a, b, c = F.abs(x), F.abs(y), F.abs(z)
    most = F.greatest(a, b, c)
    name = F.when(a == most, "sagital").when(b == most, "coronal").otherwise("axial")
    return F.when(most >= 0.97, name).otherwise(F.concat(F.lit("oblicuo(~"), name, F.lit(")")))


def suggest_order(original: Column, contrast: Column, step: Column, coverage: Column, index: Column) -> list[Column]:
    """Originals first, then contrast, small steps (in quarters, half to even), wide coverage, and the given order."""
    return [(~original).asc(), (~contrast).asc(), F.bround(step / 0.25, 0).asc(), F.coalesce(coverage, F.lit(0.0)).desc(), index.asc()]


def split_stack(df: DataFrame, by: str, position: str, instance: str, keys: list[list[str]]) -> DataFrame:
    """The rows of each series that make one stack without repeated positions, with the split that made it (`split`).

    The groupings are tried in order: the first with more than one group and no repeat inside a group wins, and its
    largest group (of equals, the one with the first row) is kept. Where none does, the first row of each position
    stays, in order of instance.
    """
    w = Window.partitionBy(by).orderBy(position)
    d = df.withColumn("__d", F.when(F.col(position) - F.lag(position).over(w) <= SAME, 1).otherwise(0))
    every = Window.partitionBy(by)
    d = d.withColumn("__dup", F.max("__d").over(every))
    choice = F.when(F.col("__dup") == 0, F.lit(0))
    for i, own in enumerate(keys, 1):
        inside = Window.partitionBy(by, *own)
        rep = F.when(F.col(position) - F.lag(position).over(inside.orderBy(position)) <= SAME, 1).otherwise(0)
        d = d.withColumn(f"__r{i}", rep).withColumn(f"__n{i}", F.count(F.lit(1)).over(inside)).withColumn(f"__f{i}", F.min(instance).over(inside))
        d = d.withColumn(f"__x{i}", F.max(f"__r{i}").over(every)).withColumn(f"__m{i}", F.min(F.struct(-F.col(f"__n{i}"), F.col(f"__f{i}"))).over(every)).withColumn(f"__c{i}", F.count(F.lit(1)).over(every))
        choice = choice.when((F.col(f"__x{i}") == 0) & (F.col(f"__c{i}") > F.col(f"__n{i}")), F.lit(i))
    d = d.withColumn("split", choice.otherwise(F.lit(-1)))
    kept = F.col("split") == 0
    for i in range(1, len(keys) + 1):
        kept = kept | ((F.col("split") == i) & (F.struct(-F.col(f"__n{i}"), F.col(f"__f{i}")) == F.col(f"__m{i}")))
    first = Window.partitionBy(by, F.round(F.col(position) / SAME).cast("long")).orderBy(instance)
    d = d.withColumn("__one", F.row_number().over(first))
    return d.where(kept | ((F.col("split") == -1) & (F.col("__one") == 1))).select(*df.columns, "split")
