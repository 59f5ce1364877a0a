"""Keyed collections as change logs, ingestion cursors, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, keys: list[str], version: list[str], deleted: str) -> DataFrame:
    """The last version of every key; keys whose last change is a deletion are gone."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r"))
    return last.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).where(~F.col(deleted)).drop(deleted)


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Conditional writes: a change (key, if_version and the same columns) counts if its if_version is the stored version, or
    null and the key is new; of several that count the first by `seq` wins. Others are stale and left out."""
    own = [c for c in current.columns if c not in (key, version)]
    ok = changes.join(current.select(key, F.col(version).alias("__v")), key, "left").where(F.col("if_version").eqNullSafe(F.col("__v")))
    first = ok.groupBy(key).agg(F.min_by(F.struct(*own), "seq").alias("__n"), F.first("__v").alias("__v"))
    new = first.select(key, *[F.col(f"__n.{c}").alias(c) for c in own], (F.coalesce("__v", F.lit(0)) + 1).alias(version))
    return current.join(new.select(key), key, "left_anti").select(key, *own, version).unionByName(new)


def since(rows: DataFrame, cursors: DataFrame, channel: str, ts: str, now: Column, days: int = 3) -> DataFrame:
    """Rows after their channel's cursor (channel, last_check); a channel without one is read `days` back."""
    c = cursors.select(F.col("channel").alias("__c"), "last_check")
    d = rows.join(c, rows[channel] == c["__c"], "left")
    return d.where(F.col(ts) > F.coalesce("last_check", now - F.expr(f"INTERVAL {days} DAYS"))).drop("__c", "last_check")


def month_grid(months: DataFrame, first: str) -> DataFrame:
    """month and the days of its calendar page, from a Monday on: 42 cells, without a last week wholly outside the month."""
    start = F.date_sub(F.col(first), F.pmod(F.dayofweek(first) + 5, F.lit(7)))
    d = months.select(F.col(first).alias("month"), F.posexplode(F.sequence(start, F.date_add(start, 41))).alias("cell", "day"))
    return d.where(~((F.col("cell") >= 35) & (F.date_add(start_of("month"), 35) > F.last_day("month"))))


def start_of(month: str) -> Column:
    return F.date_sub(F.col(month), F.pmod(F.dayofweek(month) + 5, F.lit(7)))


def renumber(df: DataFrame, by: list[str], order: list[str], place: str) -> DataFrame:
    """Only the rows whose place isn't 1, 2, ... in order, with the place that they should have."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(~F.col("__n").eqNullSafe(F.col(place))).drop(place).withColumnRenamed("__n", place)
