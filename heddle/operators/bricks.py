"""Volumes as bricks: a row holds a cube of side^3 voxels as sorted places with values, instead of a row for each voxel.

bricks() deals voxels by (vol, bk, bj, bi) once. A filter of reach r then needs r voxels of the neighbours beside each
brick: only these slabs are exchanged, to the brick that they border (an equi-join on brick coordinates), and a chain of
steps has one exchange, of slabs as wide as the steps' reaches together. Bricks saved with save_bricks() are bucketed by
their coordinates, so that they don't move at all. Work on a brick is numpy on one padded cube; a task holds one at a time.

Values of masks are bits: 1 for the mask, 2 for a limit that dilate_within keeps to. Voxels that aren't there have
value 0. `shape` is (nk, nj, ni); the last bricks of an axis may be thinner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["vol", "bk", "bj", "bi"]
SIDE = 32
SCHEMA = "vol long, bk int, bj int, bi int, at array<int>, v array<double>"
SLABS = "vol long, bk int, bj int, bi int, slab struct<at: array<int>, v: array<double>>"
MASK, LIMIT = 1, 2

#: Steps that one may chain, with their reach: a number of repeats, or 1.
REPEATED = ("dilate", "dilate_within", "erode")
SINGLE = ("contour", "crowd", "sum", "mean")


def bricks(voxels: DataFrame, side: int = SIDE, value: Column | None = None) -> DataFrame:
    """Bricks of a table vol, k, j, i (and v). A voxel given twice has the sum of its values; of a mask give F.lit(1)."""
    v = F.lit(float(MASK)) if value is None and "v" not in voxels.columns else F.col("v") if value is None else value
    low = [F.floor(F.col(c) / side).cast("int").alias(f"b{c}") for c in "kji"]
    at = (F.col("k") % side * side * side + F.col("j") % side * side + F.col("i") % side).cast("int")
    rows = voxels.select(F.col("vol").cast("long").alias("vol"), *low, F.struct(at.alias("at"), v.cast("double").alias("v")).alias("x"))
    held = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return held.select(*KEY, F.col("x.at").alias("at"), F.col("x.v").alias("v"))


def voxels(held: DataFrame, side: int = SIDE) -> DataFrame:
    """vol, k, j, i, v of bricks."""
    rows = held.select(*KEY, F.explode(F.arrays_zip("at", "v")).alias("x"))
    p = F.col("x.at")
    place = {"k": F.floor(p / (side * side)), "j": F.floor(p / side) % side, "i": p % side}
    return rows.select("vol", *[(F.col(f"b{c}") * side + place[c]).cast("int").alias(c) for c in "kji"], F.col("x.v").alias("v"))


def save_bricks(held: DataFrame, name: str, buckets: int) -> DataFrame:
    """The bricks as a table of the session's catalog, bucketed by their coordinates."""
    held.write.bucketBy(buckets, *KEY).sortBy(*KEY).mode("overwrite").saveAsTable(name)
    return held.sparkSession.table(name)


def box(held: DataFrame, vol: int, ranges: list[tuple[int, int]], side: int = SIDE) -> DataFrame:
    """The voxels of one volume within half-open ranges of k, j and i; only bricks that meet the box are read."""
    kept = held.where(F.col("vol") == vol)
    for c, (lo, hi) in zip("kji", ranges):
        kept = kept.where(F.col(f"b{c}").between(lo // side, (hi - 1) // side))
    inside = voxels(kept, side)
    for c, (lo, hi) in zip("kji", ranges):
        inside = inside.where(F.col(c).between(lo, hi - 1))
    return inside


class Frame:
    """Where a brick lies in its volume, and its padded cube."""

    def __init__(self, shape: tuple[int, int, int], side: int, width: int):
        self.shape, self.side, self.width = shape, side, width
        self.count = [-(-n // side) for n in shape]

    def size(self, b: tuple[int, ...]) -> list[int]:
        return [min(self.side, n - x * self.side) for n, x in zip(self.shape, b)]

    def padded(self, b: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(n + 2 * self.width for n in self.size(b))

    def coordinates(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        return at // self.side**2, at // self.side % self.side, at % self.side

    def slabs(self, b: tuple[int, ...], at: np.ndarray, faces: bool, wrap: bool) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
        """Target, which voxels, and their places in the target's padded cube."""
        own, size, w = self.coordinates(at), self.size(b), self.width
        for d in product((-1, 0, 1), repeat=3):
            if not any(d) or faces and sum(map(abs, d)) > 1:
                continue
            target = [x + y for x, y in zip(b, d)]
            if wrap:
                target = [t % n for t, n in zip(target, self.count)]
            elif not all(0 <= t < n for t, n in zip(target, self.count)):
                continue
            cube, there, taken, where = self.padded(tuple(target)), self.size(tuple(target)), np.ones(len(at), bool), []
            for x, step, n, m in zip(own, d, size, there):
                place = x if step == 0 else x - n if step > 0 else x + m  # against the target's first voxel
                taken &= (place >= -w) & (place < m + w)
                where.append(place + w)
            if taken.any():
                yield tuple(target), taken, np.ravel_multi_index([p[taken] for p in where], cube)

    def cube(self, b: tuple[int, ...], at: np.ndarray, v: np.ndarray, halo: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros(self.padded(b))
        w, (nk, nj, ni) = self.width, self.size(b)
        own = np.zeros((nk, nj, ni))
        np.add.at(own, self.coordinates(at), v)
        out[w : w + nk, w : w + nj, w : w + ni] = own
        for places, values in halo:
            np.add.at(out.reshape(-1), places, values)
        return out

    def inside(self, b: tuple[int, ...]) -> np.ndarray:
        """Which places of the padded cube are in the volume."""
        lines = []
        for x, m, n in zip(b, self.padded(b), self.shape):
            g = np.arange(m) + x * self.side - self.width
            lines.append((g >= 0) & (g < n))
        return lines[0][:, None, None] & lines[1][None, :, None] & lines[2][None, None, :]

    def core(self, cube: np.ndarray) -> np.ndarray:
        w = self.width
        return cube[w : cube.shape[0] - w, w : cube.shape[1] - w, w : cube.shape[2] - w]


def _faces(cube: np.ndarray, beyond: bool, join: Callable) -> np.ndarray:
    out, p = cube.copy(), np.pad(cube, 1, constant_values=beyond)
    for axis in range(3):
        for step in (0, 2):
            at = [slice(1, -1)] * 3
            at[axis] = slice(step, step + cube.shape[axis])
            out = join(out, p[tuple(at)])
    return out


def _cube_sum(cube: np.ndarray) -> np.ndarray:
    for axis in range(3):
        p = np.pad(cube, [(1, 1) if a == axis else (0, 0) for a in range(3)])
        cut = lambda s: p[tuple(slice(s, s + cube.shape[axis]) if a == axis else slice(None) for a in range(3))]  # noqa: B023, E731
        cube = cut(0) + cut(1) + cut(2)
    return cube


def _run(steps: list[tuple], cube: np.ndarray, inside: np.ndarray, mode: str) -> np.ndarray:
    """The steps on a padded cube; places nearer to its border than the steps' reach may be wrong."""
    if steps[0][0] in ("sum", "mean"):
        if mode == "edge":  # each axis' first and last voxel stands for what is beyond it
            for axis in range(3):
                line = np.flatnonzero(inside.any(axis=tuple(a for a in range(3) if a != axis)))
                cube = np.take(cube, np.clip(np.arange(cube.shape[axis]), line[0], line[-1]), axis=axis)
        total = _cube_sum(cube)
        return total / 27 if steps[0][0] == "mean" else total
    bits = cube.astype(np.int64)
    mask, limit = (bits & MASK) > 0, (bits & LIMIT) > 0
    for name, *n in steps:
        for _ in range(n[0] if name in REPEATED else 1):
            if name in ("dilate", "dilate_within"):
                mask = _faces(mask, False, np.logical_or) & inside
                if name == "dilate_within":
                    mask &= limit
            elif name == "crowd":
                mask &= _cube_sum(mask.astype(np.int64)) >= n[0]
            else:
                thin = _faces(mask | ~inside, True, np.logical_and) & inside
                mask = mask & ~thin if name == "contour" else thin
    return mask.astype(np.float64) * MASK


def reach(steps: list[tuple]) -> int:
    """The width of slabs that a chain needs."""
    for name, *_ in steps:
        if name not in REPEATED + SINGLE:
            raise ValueError(f"no such step: {name}")
    if any(s[0] in ("sum", "mean") for s in steps) and len(steps) > 1:
        raise ValueError("a sum or mean of values is a chain of its own")
    return sum(s[1] if s[0] in REPEATED else 1 for s in steps)


def filtered(held: DataFrame, steps: list[tuple], shape: tuple[int, int, int], side: int = SIDE, mode: str = "constant") -> DataFrame:
    """Bricks after a chain of steps: ("dilate", n), ("dilate_within", n), ("erode", n), ("contour",), ("crowd", least), or one
    of ("sum",) and ("mean",), over boxes of 3 x 3 x 3.

    Outside the volume counts as unset for dilation and crowds, as set for erosion and contours; for sums it is 0
    ('constant'), the border again ('edge') or the far side ('wrap'). Sums and means are given for every voxel of a
    volume's bricks that exist; a mask's bricks come into being where it grows. An empty brick isn't given.
    """
    width = reach(steps)
    if width > side:
        raise ValueError(f"steps reach {width} voxels, over a whole brick of {side}")
    frame, wrap = Frame(shape, side, width), mode == "wrap"
    faces = width == 1 and steps[0][0] not in ("crowd", "sum", "mean")
    whole = steps[0][0] in ("sum", "mean")

    def rows(b: pa.RecordBatch, first: int = 0) -> Iterator[tuple]:
        for r in range(b.num_rows):
            at, v = (b.column(first + 4 + k)[r].values for k in (0, 1))
            yield b.column(0)[r].as_py(), tuple(b.column(c)[r].as_py() for c in (1, 2, 3)), np.asarray(at if at is not None else [], np.int64), np.asarray(v if v is not None else [], np.float64)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = pa.struct([("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))])
        for b in batches:
            for vol, place, at, v in rows(b):
                found = [(vol, *t, {"at": where.astype(np.int32), "v": v[taken]}) for t, taken, where in frame.slabs(place, at, faces, wrap)]
                if found:
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:4]), pa.array(cols[4], slab)], [*KEY, "slab"])

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            halos = b.column(6)
            for r, (vol, place, at, v) in enumerate(rows(b)):
                halo = [(np.asarray(s["at"].values, np.int64), np.asarray(s["v"].values, np.float64)) for s in halos[r].values] if halos[r].is_valid else []
                if whole and not b.column(4)[r].is_valid:
                    continue
                out = frame.core(_run(steps, frame.cube(place, at, v, halo), frame.inside(place), mode))
                k, j, i = np.unravel_index(np.arange(out.size), out.shape)
                value = out.reshape(-1)
                kept = np.ones(out.size, bool) if whole else value != 0
                if kept.any():
                    at = (k * side * side + j * side + i)[kept].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([vol], pa.int64()), *(pa.array([x], pa.int32()) for x in place), pa.array([at], pa.list_(pa.int32())), pa.array([value[kept]], pa.list_(pa.float64()))], [*KEY, "at", "v"])

    slabs = held.select(*KEY, "at", "v").mapInArrow(sent, SLABS).groupBy(*KEY).agg(F.collect_list("slab").alias("halo"))
    both = held.select(*KEY, "at", "v").hint("merge").join(slabs, KEY, "left" if whole else "full").select(*KEY, "at", "v", "halo")
    return both.mapInArrow(worked, SCHEMA)


def stacked(spark: SparkSession, vectors: DataFrame, vec_id: str, values: str, across: int = 4, cell: int = 4) -> DataFrame:
    """vol, k, j, i, v: vectors of cell^3 values, across^3 of them (by id) side by side in a volume."""
    n = F.col("n")
    each = vectors.select(F.col(vec_id).alias("n"), F.posexplode(values).alias("p", "v"))
    own = {"k": F.floor(F.col("p") / (cell * cell)), "j": F.floor(F.col("p") / cell) % cell, "i": F.col("p") % cell}
    of = {"k": F.floor(n / (across * across)) % across, "j": F.floor(n / across) % across, "i": n % across}
    return each.select(F.floor(n / across**3).alias("vol"), *[(of[c] * cell + own[c]).cast("int").alias(c) for c in "kji"], F.col("v").cast("double").alias("v"))
