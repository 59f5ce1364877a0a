"""The course of a hollow organ or vessel through a volume: followed from slice to slice, or given by points.

Voxels are rows (vol, k, j, i, v). Smoothing, thresholds, pieces of slices (in-plane components), their centres and the
cells they share with the slice before are joins, windows and sums over voxels. Only a volume's pieces, a few rows a
slice, meet in the fold that chooses one after another. Gaps, smoothing, tangents and radii are windows over the course.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequences as S
from .voxels import roots

AXES = "kji"
COURSE = "vol long, s int, a double, b double, area double, gap boolean, forced boolean"
PIECES = "vol long, s int, a int, b int, piece long"


def in_slices(grid: DataFrame, axis: str) -> DataFrame:
    """vol, s (place along the axis), a, b (the two others, in k, j, i order), v."""
    a, b = [c for c in AXES if c != axis]
    return grid.select(F.col("vol").cast("long").alias("vol"), F.col(axis).cast("int").alias("s"), F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b"), F.col("v").cast("double").alias("v"))


def plane_mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    """v as the mean of 3 x 3 cells in a plane; the border stands for what is beyond it."""
    for c, other in (("a", "b"), ("b", "a")):
        w = Window.partitionBy(*keys, other).orderBy(c)
        rows = rows.withColumn("v", F.coalesce(F.lag("v").over(w), "v") + F.col("v") + F.coalesce(F.lead("v").over(w), "v"))
    return rows.withColumn("v", F.col("v") / 9)


def within(v: Column, lo: float | None, hi: float | None) -> Column:
    """Strictly between the bounds that are given."""
    out = F.lit(True)
    if lo is not None:
        out &= v > lo
    if hi is not None:
        out &= v < hi
    return out


def label_plane(cells: DataFrame) -> DataFrame:
    """vol, s, a, b, piece: each set cell's in-plane component, named by its first cell in (a, b) order. A slice is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                at = np.asarray(batch.column(2)[r].values, np.int64)
                a, b = at >> 32, at & 0xFFFFFFFF
                a0, b0, wide = a.min(), b.min(), int(b.max() - b.min()) + 1
                place = np.sort((a - a0) * wide + (b - b0))
                root = roots(place, (1, int(a.max() - a0) + 1, wide), True)
                a, b, first = place // wide + a0, place % wide + b0, ((root // wide + a0) << 32) + root % wide + b0
                n = len(place)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[r].as_py()] * n, pa.int64()), pa.array([batch.column(1)[r].as_py()] * n, pa.int32()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(first)], ["vol", "s", "a", "b", "piece"])

    held = cells.groupBy("vol", "s").agg(F.collect_list(F.shiftleft(F.col("a").cast("long"), 32) + F.col("b").cast("long")).alias("at"))
    return held.mapInArrow(run, PIECES)


def pieces(grid: DataFrame, axis: str, lo: float | None, hi: float | None, least: int = 4) -> DataFrame:
    """vol, s, piece, area (cells), a, b (centre), shared (of pieces of the slice before: piece and cells in common)."""
    cells = label_plane(plane_mean(in_slices(grid, axis), ["vol", "s"]).where(within(F.col("v"), lo, hi)))
    size = cells.groupBy("vol", "s", "piece").agg(F.count(F.lit(1)).alias("area"), F.avg("a").alias("a"), F.avg("b").alias("b")).where(F.col("area") >= least)
    before = cells.select("vol", (F.col("s") + 1).alias("s"), "a", "b", F.col("piece").alias("other"))
    common = cells.join(before, ["vol", "s", "a", "b"]).groupBy("vol", "s", "piece", "other").agg(F.count(F.lit(1)).alias("n"))
    shared = common.groupBy("vol", "s", "piece").agg(F.collect_list(F.struct("other", "n")).alias("shared"))
    return size.join(shared, ["vol", "s", "piece"], "left")


def _choose(rows: pd.DataFrame, points: dict[int, tuple[float, float]], jump: float, spacing: tuple[float, float]) -> list[tuple]:
    """(s, a, b, area, gap, forced) from the first known slice to the last."""
    by_slice = {s: own.sort_values("piece") for s, own in rows.groupby("s")}
    chosen: dict[int, tuple] = {}
    held = centre = None
    known = [*by_slice, *points]
    for s in range(min(known), max(known) + 1):
        own, pick = by_slice.get(s), None
        aim = points.get(s, centre)
        if own is not None:
            if held is not None and s not in points:
                overlap = [next((x["n"] for x in (row if row is not None else ()) if x["other"] == held), 0) for row in own["shared"]]
                pick = int(np.argmax(overlap)) if max(overlap) else None
            if pick is None and aim is not None:
                far = np.hypot((own["a"].to_numpy() - aim[0]) * spacing[0], (own["b"].to_numpy() - aim[1]) * spacing[1])
                pick = int(far.argmin()) if far.min() <= jump else None
            elif pick is None:
                pick = int(own["area"].to_numpy().argmax())
        if pick is None:
            held, centre = None, points.get(s, centre)
            continue
        row = own.iloc[pick]
        held, centre = row["piece"], (row["a"], row["b"])
        chosen[s] = (*centre, float(row["area"]))
    ends = sorted({*chosen, *points})
    out = []
    for s in range(ends[0], ends[-1] + 1) if ends else ():
        if s in chosen:
            out.append((s, *chosen[s], False, False))
        else:
            out.append((s, *points.get(s, (None, None)), 0.0, True, s in points))
    return out


def follow(found: DataFrame, points: DataFrame | None = None, axis: str = "k", jump: float = 12.0, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The piece followed in every slice (COURSE), and way points (vol, n, k, j, i) where there is none.

    A piece that shares most cells with the one before goes on (of equals the first); in a way point's slice, and after a
    gap, the nearest to the way point or to the last centre, at most `jump` mm away; with neither, the largest. A slice
    without one is a gap (a, b null), but for a way point's own, which the course passes through. Of way points in one
    slice the last counts.
    """
    other = [AXES.index(c) for c in AXES if c != axis]
    apart = tuple(spacing[x] for x in other)
    names = [AXES[x] for x in other]

    def run(key: tuple, own: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        at = {int(p[0]): (p[1], p[2]) for p in way.sort_values("n")[["s", "a", "b"]].to_numpy()}
        rows = _choose(own, at, jump, apart) if len(own) or at else []
        out = pd.DataFrame(rows, columns=["s", "a", "b", "area", "gap", "forced"])
        out.insert(0, "vol", key[0])
        return out

    if points is None:
        points = found.select("vol", F.lit(0).alias("n"), *[F.lit(0.0).alias(c) for c in AXES]).limit(0)
    way = points.select(F.col("vol").cast("long").alias("vol"), F.col("n").cast("int").alias("n"), F.bround(axis).cast("int").alias("s"), F.col(names[0]).cast("double").alias("a"), F.col(names[1]).cast("double").alias("b"))
    return found.groupBy("vol").cogroup(way.groupBy("vol")).applyInPandas(run, COURSE)


def course(followed: DataFrame, axis: str = "k", smooth: int = 5, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """vol, n, k, j, i, s_mm, radius, gap, forced of a followed course.

    Gaps are filled along the slices, centres are smoothed over `smooth` slices (forced points stay), and the radius is that
    of a disc with the piece's area times the cosine between course and slice normal; 0 in a gap.
    """
    a, b = [c for c in AXES if c != axis]
    order, by = ["s"], "vol"
    d = followed.withColumns({c: S.fill(c, "s", by, order) for c in "ab"})
    d = d.withColumns({f"{c}_": F.when(F.col("forced"), F.col(c)).otherwise(S.moving_average(c, by, order, smooth)) for c in "ab"})
    d = d.select("vol", "s", "area", "gap", "forced", F.col("s").cast("double").alias(axis), F.col("a_").alias(a), F.col("b_").alias(b))
    return _measured(d, axis, order, spacing, lambda cos: F.sqrt(F.col("area") * spacing[AXES.index(a)] * spacing[AXES.index(b)] * cos / F.lit(np.pi)))


def _measured(d: DataFrame, axis: str, order: list[str], spacing: tuple[float, float, float], radius) -> DataFrame:
    d = d.withColumns({f"{c}_mm": F.col(c) * x for c, x in zip(AXES, spacing)})
    mm = [f"{c}_mm" for c in AXES]
    cos = F.abs(S.tangents(mm, "vol", order)[AXES.index(axis)])
    d = d.withColumn("radius", F.when(F.col("gap"), 0.0).otherwise(radius(cos)))
    d = S.arc_length(d, "vol", order, mm, "s_mm").withColumn("n", F.row_number().over(S.ordered("vol", order)) - 1)
    return d.select("vol", "n", *AXES, "s_mm", "radius", "gap", *[c for c in ("forced",) if c in d.columns])


def between(points: DataFrame, step: float = 1.0, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """vol, leg, t, k, j, i: way points (vol, n, k, j, i) and points between them, `step` mm apart at most; way points stay."""
    w = Window.partitionBy("vol").orderBy("n")
    legs = points.select("vol", F.row_number().over(w).alias("leg"), *[F.col(c).cast("double").alias(c) for c in AXES], *[F.lead(F.col(c).cast("double")).over(w).alias(f"{c}_to") for c in AXES])
    length = F.sqrt(sum(F.pow((F.col(f"{c}_to") - F.col(c)) * x, F.lit(2.0)) for c, x in zip(AXES, spacing)))
    parts = F.greatest(F.lit(1), F.coalesce(F.ceil(length / step), F.lit(1)).cast("int"))
    cut = legs.withColumn("m", parts).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return cut.select("vol", "leg", "t", *[F.coalesce(F.col(c) + (F.col(f"{c}_to") - F.col(c)) * F.col("t") / F.col("m"), F.col(c)).alias(c) for c in AXES])


def local_area(grid: DataFrame, points: DataFrame, axis: str, lo: float | None, hi: float | None, shape: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), window: float = 25.0, search: float = 3.0, tile: int = 16) -> DataFrame:
    """vol, leg, t, cells: of each point the cells of the lumen in the slice through it, 0 where none is near.

    The slice is perpendicular to the axis at the nearest voxel; its 3 x 3 means within `window` mm are held to the range,
    and the component at the point counts, or that of the cell nearest to it, if within `search` mm (of equals the first).
    Points meet voxels on tiles of the slice: each asks for the few tiles that its window reaches.
    """
    (ia, a), (ib, b) = [(AXES.index(c), c) for c in AXES if c != axis]
    reach = {"a": int(window / spacing[ia]), "b": int(window / spacing[ib])}
    limit = {"a": shape[ia], "b": shape[ib]}
    at = points.select("vol", "leg", "t", F.bround(axis).cast("int").alias("s"), F.bround(a).cast("int").alias("pa"), F.bround(b).cast("int").alias("pb"))
    at = at.where(F.col("s").between(0, shape[AXES.index(axis)] - 1) & F.col("pa").between(0, limit["a"] - 1) & F.col("pb").between(0, limit["b"] - 1))
    for c in "ab":
        low, high = F.greatest(F.lit(0), F.col(f"p{c}") - reach[c]), F.least(F.lit(limit[c] - 1), F.col(f"p{c}") + reach[c])
        at = at.withColumn(f"low_{c}", low).withColumn(f"high_{c}", high)
        at = at.withColumn(f"tile_{c}", F.explode(F.sequence(F.floor(F.col(f"low_{c}") / tile).cast("int"), F.floor(F.col(f"high_{c}") / tile).cast("int"))))
    cells = in_slices(grid, axis).withColumns({f"tile_{c}": F.floor(F.col(c) / tile).cast("int") for c in "ab"})
    near = at.join(cells, ["vol", "s", "tile_a", "tile_b"]).where(F.col("a").between(F.col("low_a"), F.col("high_a")) & F.col("b").between(F.col("low_b"), F.col("high_b")))
    near = plane_mean(near.select("vol", "leg", "t", "pa", "pb", "a", "b", "v"), ["vol", "leg", "t"]).where(within(F.col("v"), lo, hi))
    held = near.groupBy("vol", "leg", "t", "pa", "pb").agg(F.collect_list(F.shiftleft(F.col("a").cast("long"), 32) + F.col("b").cast("long")).alias("at"))
    ea, eb = spacing[ia], spacing[ib]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = []
            for r in range(batch.num_rows):
                xy = np.sort(np.asarray(batch.column(5)[r].values, np.int64))
                x, y = xy >> 32, xy & 0xFFFFFFFF
                wide = int(y.max()) + 1
                place = x * wide + y
                root = roots(place, (1, int(x.max()) + 1, wide), True)
                far = np.hypot((x - batch.column(3)[r].as_py()) * ea, (y - batch.column(4)[r].as_py()) * eb)
                best = int(far.argmin())  # a cell at the point itself is at distance 0
                areas.append(int((root == root[best]).sum()) if far[best] <= search else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(areas, pa.int64())], ["vol", "leg", "t", "cells"])

    return held.select("vol", "leg", "t", "pa", "pb", "at").mapInArrow(run, "vol long, leg int, t int, cells long")


def by_points(grid: DataFrame, points: DataFrame, axis: str, lo: float | None, hi: float | None, shape: tuple[int, int, int], step: float = 1.0, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), window: float = 25.0, search: float = 3.0) -> DataFrame:
    """vol, n, k, j, i, s_mm, radius, gap of a course given by way points; where no lumen is near the radius is 0, a gap."""
    line = between(points.withColumn("vol", F.col("vol").cast("long")), step, spacing)
    area = local_area(grid, line, axis, lo, hi, shape, spacing, window, search)
    d = line.join(area, ["vol", "leg", "t"], "left").withColumn("area", F.coalesce(F.col("cells"), F.lit(0)))
    mm2 = float(np.prod([x for c, x in zip(AXES, spacing) if c != axis]))
    d = _measured(d.withColumn("gap", F.lit(False)), axis, ["leg", "t"], spacing, lambda cos: F.sqrt(F.col("area") * mm2 * cos / F.lit(np.pi)))
    return d.withColumn("gap", F.col("radius") <= 0)


def summary(measured: DataFrame) -> DataFrame:
    """vol, points, length, gaps, gap_length (each point counts half the way to either neighbour), least, most and median
    radius outside gaps."""
    gaps = S.run_length(measured, "vol", ["n"], "s_mm", F.col("gap")).groupBy("vol").agg(F.count(F.lit(1)).alias("gaps"), F.sum("length").alias("gap_length"))
    open_ = F.when(~F.col("gap"), F.col("radius"))
    own = measured.groupBy("vol").agg(F.count(F.lit(1)).alias("points"), F.max("s_mm").alias("length"), F.min(open_).alias("least"), F.max(open_).alias("most"), F.median(open_).alias("median"))
    return own.join(gaps, "vol", "left").select("vol", "points", "length", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), F.coalesce("gap_length", F.lit(0.0)).alias("gap_length"), "least", "most", "median")
