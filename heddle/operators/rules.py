"""Data rules as one table of violations, and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, path: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """path, severity, rule for every row and rule (name, severity, broken) that is broken. One pass over df."""
    hits = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rule"))) for n, s, broken in rules])
    return df.select(path.alias("path"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("path", "h.severity", "h.rule")


def blocked(found: DataFrame) -> DataFrame:
    """errors, warnings, and whether the errors block the output."""
    return found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("blocks", F.col("errors") > 0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(df: DataFrame, key: str, target: DataFrame, other: str) -> DataFrame:
    """Rows whose key is set but isn't found."""
    return df.where(F.col(key).isNotNull()).join(target.select(F.col(other).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def compare(one: DataFrame, two: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """keys and status (missing, extra, differs, same) of two tables; values within the tolerance are the same."""
    a = one.select(*keys, *[F.col(v).alias(f"__a{v}") for v in values], F.lit(True).alias("__a"))
    b = two.select(*keys, *[F.col(v).alias(f"__b{v}") for v in values], F.lit(True).alias("__b"))
    off = F.lit(False)
    for v in values:
        off = off | (F.abs(F.col(f"__a{v}") - F.col(f"__b{v}")) > tolerance)
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(off, "differs").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def near_colours(df: DataFrame, key: str, r: str, g: str, b: str, limit: float, cell: int = 40) -> DataFrame:
    """Pairs (a < b) of colours nearer than the limit. Colours meet only in equal or neighbouring cells of the cube, so this
    is an equi-join; the cell must not be smaller than the limit."""
    if cell < limit:
        raise ValueError("the cell is smaller than the limit")
    base = df.select(F.col(key).alias("id"), *[F.col(c).alias(n) for c, n in zip((r, g, b), "rgb")])
    base = base.withColumns({f"c{n}": F.floor(F.col(n) / cell) for n in "rgb"})
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = base.select(*[F.col(c).alias(f"_{c}") for c in ("id", "r", "g", "b")], *[F.col(f"c{n}").alias(f"_c{n}") for n in "rgb"])
    for n in "rgb":
        spread = spread.withColumn(f"o{n}", F.explode(step)).withColumn(f"c{n}", F.col(f"_c{n}") + F.col(f"o{n}"))
    pairs = base.join(spread, ["cr", "cg", "cb"]).where("id < _id")
    d = F.sqrt(sum(((F.col(n) - F.col(f"_{n}")) * (F.col(n) - F.col(f"_{n}")) for n in "gb"), (F.col("r") - F.col("_r")) * (F.col("r") - F.col("_r"))))
    return pairs.withColumn("distance", d).where(F.col("distance") < limit).select(F.col("id").alias("a"), F.col("_id").alias("b"), "distance")


def contained(boxes: DataFrame, points: DataFrame, axes: str, cell: float) -> DataFrame:
    """box, n: how many points lie in each box (low_, high_ of each axis; ends included). Boxes are dealt to the cells of their
    first axis, so only points in those cells meet them."""
    low, high = F.floor(F.col(f"low_{axes[0]}") / cell), F.floor(F.col(f"high_{axes[0]}") / cell)
    b = boxes.withColumn("__c", F.explode(F.sequence(low, high)))
    p = points.withColumn("__c", F.floor(F.col(axes[0]) / cell))
    hit = F.lit(True)
    for c in axes:
        hit = hit & F.col(c).between(F.col(f"low_{c}"), F.col(f"high_{c}"))
    found = b.join(p, "__c").where(hit).groupBy("box").agg(F.count(F.lit(1)).alias("n"))
    return boxes.select("box").join(found, "box", "left").select("box", F.coalesce("n", F.lit(0)).alias("n"))
