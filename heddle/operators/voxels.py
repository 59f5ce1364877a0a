"""Morphology on sparse masks (vol, k, j, i of the true voxels) and dense grids (with v).

Neighbours are found by exploding the few offsets around a voxel and grouping or joining by the shifted coordinates,
never by a join on distance. `shape` is (nk, nj, ni).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.lineage import cut

from .graph import components as graph_components

KEY = ["vol", "k", "j", "i"]
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
BOX = list(product((-1, 0, 1), repeat=3))
#: Voxels of a volume whose places are held in one row, so that a batch of volumes is bounded too.
SMALL = 4096


def dense(df: DataFrame, vol: str, values: str, shape: tuple[int, int, int]) -> DataFrame:
    """vol, k, j, i, v of an array of values in k, j, i order."""
    _, nj, ni = shape
    p = F.col("p")
    d = df.select(F.col(vol).alias("vol"), F.posexplode(values).alias("p", "v"))
    return d.select("vol", F.floor(p / (nj * ni)).cast("int").alias("k"), (F.floor(p / ni) % nj).cast("int").alias("j"), (p % ni).cast("int").alias("i"), F.col("v").cast("double").alias("v"))


def inside(shape: tuple[int, int, int]) -> Column:
    return F.col("k").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1) & F.col("i").between(0, shape[2] - 1)


def shifted(mask: DataFrame, offsets: list[tuple[int, int, int]], shape: tuple[int, int, int] | None = None) -> DataFrame:
    """A row for each voxel and offset, moved by the offset; outside the grid they are dropped."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in offsets])
    d = mask.select(*KEY, F.explode(steps).alias("o")).select("vol", (F.col("k") + F.col("o.a")).alias("k"), (F.col("j") + F.col("o.b")).alias("j"), (F.col("i") + F.col("o.c")).alias("i"))
    return d.where(inside(shape)) if shape else d


def dilate(mask: DataFrame, shape: tuple[int, int, int], n: int = 1, limit: DataFrame | None = None) -> DataFrame:
    """Grown by face neighbours n times, held to `limit` after each."""
    for _ in range(n):
        mask = shifted(mask, [(0, 0, 0), *FACES], shape).distinct()
        if limit is not None:
            mask = mask.join(limit.select(*KEY), KEY, "left_semi")
    return mask


def erode(mask: DataFrame, shape: tuple[int, int, int], n: int = 1) -> DataFrame:
    """Voxels all of whose face neighbours in the grid are set, n times; outside the grid counts as set."""
    for _ in range(n):
        own = mask.select(*KEY, F.lit(True).alias("own"))
        near = shifted(mask, FACES, shape).withColumn("own", F.lit(False))
        wanted = sum((F.when(F.col(c) > 0, 1).otherwise(0) + F.when(F.col(c) < m - 1, 1).otherwise(0) for c, m in zip("kji", shape)), F.lit(0))
        counted = own.unionByName(near).groupBy(*KEY).agg(F.bool_or("own").alias("own"), F.count_if(~F.col("own")).alias("n"))
        mask = counted.where(F.col("own") & (F.col("n") == wanted)).select(*KEY)
    return mask


def box_sum(grid: DataFrame, mode: str = "edge", value: str = "v") -> DataFrame:
    """Sums over 3 x 3 x 3 boxes of a dense grid, axis by axis; outside is 0 ('constant'), the border again ('edge') or the far side ('wrap')."""
    d = grid.select(*KEY, F.col(value).cast("double").alias("v"))
    for axis in "kji":
        w = Window.partitionBy(*[c for c in KEY if c != axis]).orderBy(axis)
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        low, high = {"constant": (F.lit(0.0), F.lit(0.0)), "edge": (F.col("v"), F.col("v")), "wrap": (F.last("v").over(every), F.first("v").over(every))}[mode]
        d = d.withColumn("v", F.coalesce(F.lag("v").over(w), low) + F.col("v") + F.coalesce(F.lead("v").over(w), high))
    return d


def keep_crowded(mask: DataFrame, least: int, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels with at least so many set voxels in their 3 x 3 x 3 box, themselves included; outside is unset."""
    own = mask.select(*KEY, F.lit(True).alias("own"))
    counted = own.unionByName(shifted(mask, BOX, shape).withColumn("own", F.lit(False))).groupBy(*KEY).agg(F.bool_or("own").alias("own"), F.count_if(~F.col("own")).alias("n"))
    return counted.where(F.col("own") & (F.col("n") >= least)).select(*KEY)


def edges(mask: DataFrame, shape: tuple[int, int, int], plane: bool = False) -> DataFrame:
    """a, b: pairs of set face neighbours, as (vol, place) structs; in-plane only with `plane`."""
    _, nj, ni = shape
    node = lambda k, j, i: F.struct("vol", (k * (nj * ni) + j * ni + i).alias("p"))
    own = mask.select(*KEY)
    out = None
    for step in [o for o in FACES if sum(o) > 0 and not (plane and o[0])]:
        moved = own.select("vol", *[(F.col(c) + o).alias(c) for c, o in zip("kji", step)])
        pair = own.join(moved, KEY, "left_semi").select(node(*[F.col(c) - o for c, o in zip("kji", step)]).alias("a"), node(*[F.col(c) for c in "kji"]).alias("b"))
        out = pair if out is None else out.unionByName(pair)
    return out


def label(mask: DataFrame, shape: tuple[int, int, int], plane: bool = False) -> DataFrame:
    """vol, k, j, i, label of every set voxel: the smallest place (k, j, i order) in its component."""
    _, nj, ni = shape
    own = mask.select(*KEY, (F.col("k") * (nj * ni) + F.col("j") * ni + F.col("i")).alias("p"))
    found = graph_components(edges(mask, shape, plane)).select(F.col("node.vol").alias("vol"), F.col("node.p").alias("p"), F.col("component.p").alias("c"))
    return own.join(found, ["vol", "p"], "left").select(*KEY, F.coalesce("c", "p").alias("label"))


def roots(place: np.ndarray, shape: tuple[int, int, int], plane: bool = False) -> np.ndarray:
    """Of ascending places volume x size + (k, j, i place), the smallest place of each one's component: the links to the
    next voxel of each axis are hung on their smaller ends until nothing moves."""
    size, label = int(np.prod(shape)), np.arange(len(place))
    links = []
    for step, n in ((1, shape[2]), (shape[2], shape[1]), (shape[1] * shape[2], shape[0]))[: 2 if plane else 3]:
        at = np.minimum(np.searchsorted(place, place + step), max(len(place) - 1, 0))
        links.append(np.stack([np.arange(len(place)), at])[:, (place[at] == place + step) & (place % size // step % n < n - 1)])
    one, two = np.concatenate(links, axis=1)
    while len(one):
        low = np.minimum(label[one], label[two])
        np.minimum.at(label, label[one], low)
        np.minimum.at(label, label[two], low)
        while (label != (up := label[label])).any():
            label = up
        left = label[one] != label[two]
        one, two = one[left], two[left]
    return place[label]


def label_small(mask: DataFrame, shape: tuple[int, int, int], plane: bool = False) -> DataFrame:
    """label() where a volume's set voxels are few enough for one row; many volumes are joined up at a time."""
    _, nj, ni = shape
    size, (k, j, i) = int(np.prod(shape)), (F.col(c).cast("long") for c in "kji")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            place = np.sort(row * size + np.asarray(lists.flatten(), np.int64))
            root, row, p = roots(place, shape, plane), place // size, place % size
            cols = [b.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (p // (nj * ni), p // ni % nj, p % ni)), pa.array(root % size)]
            yield pa.RecordBatch.from_arrays(cols, [*KEY, "label"])

    held = mask.groupBy(F.col("vol").cast("long").alias("vol")).agg(F.collect_list(k * (nj * ni) + j * ni + i).alias("at"))
    return held.mapInArrow(run, "vol long, k int, j int, i int, label long")


def labelled(mask: DataFrame, shape: tuple[int, int, int], plane: bool = False) -> DataFrame:
    """label_small() where the shape has at most SMALL voxels, else label()."""
    return (label_small if np.prod(shape) <= SMALL else label)(mask, shape, plane)


def hanging(mask: DataFrame, seeds: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The voxels of the mask's components that hold a seed. In small volumes a volume's places and seeds come together in one
    row, made up before the exchange; seeds off the mask don't count."""
    if np.prod(shape) > SMALL:
        labels = label(mask, shape)
        hit = labels.join(seeds, KEY, "left_semi").select("vol", "label").distinct()
        return labels.join(hit, ["vol", "label"], "left_semi").select(*KEY)
    _, nj, ni = shape
    size, (k, j, i) = int(np.prod(shape)), (F.col(c).cast("int") for c in "kji")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = []
            for lists in b.columns[1:]:
                row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
                places.append(np.unique(row * size + np.asarray(lists.flatten(), np.int64)))
            place, seed = places
            root = roots(place, shape)
            place = place[np.isin(root, root[np.isin(place, seed)])]
            row, p = place // size, place % size
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (p // (nj * ni), p // ni % nj, p % ni))], KEY)

    both = mask.select(*KEY, F.lit(False).alias("seed")).unionByName(seeds.where(inside(shape)).select(*KEY, F.lit(True).alias("seed")))
    at = k * (nj * ni) + j * ni + i
    held = both.groupBy(F.col("vol").cast("long").alias("vol")).agg(*[F.collect_list(F.when(F.col("seed") == s, at)).alias(n) for n, s in (("at", False), ("seeds", True))])
    return held.mapInArrow(run, "vol long, k int, j int, i int")


def largest(labels: DataFrame) -> DataFrame:
    """The voxels of each volume's largest component; of equals the one that comes first."""
    size = labels.groupBy("vol", "label").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("vol").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b")).select("vol", (-F.col("b.m")).alias("label"))
    return labels.join(best, ["vol", "label"], "left_semi").select(*KEY)


def grow(mask: DataFrame, seeds: DataFrame, shape: tuple[int, int, int], erosion: int = 0, steps: int | None = None, reach: tuple[int, int, int] = (4, 6, 6)) -> DataFrame:
    """The part of a mask that hangs on seeds (vol, k, j, i): eroded, components (or `steps` growths) of the seeds, dilated
    back inside the mask. A seed off the eroded mask moves to the nearest voxel within `reach`; without one it is ignored."""
    thin = erode(mask, shape, erosion) if erosion else mask.select(*KEY)
    near = seeds.select("vol", *[F.col(c).cast("int").alias(f"s{c}") for c in "kji"]).distinct()
    for c, r, n in zip("kji", reach, shape):  # every place in the grid that a seed may move to, so that the join is on places
        low, high = F.greatest(F.col(f"s{c}") - r, F.lit(0)), F.least(F.col(f"s{c}") + r, F.lit(n - 1))
        near = near.where(low <= high).withColumn(c, F.explode(F.sequence(low, high)))
    d2 = sum(((F.col(c) - F.col(f"s{c}")) * (F.col(c) - F.col(f"s{c}")) for c in "ji"), (F.col("k") - F.col("sk")) * (F.col("k") - F.col("sk")))
    snapped = thin.join(near, KEY).groupBy("vol", "sk", "sj", "si").agg(F.min(F.struct(d2.alias("d"), "k", "j", "i")).alias("m")).select("vol", "m.k", "m.j", "m.i").distinct()
    if steps is None:
        region = hanging(thin, snapped, shape)
    else:
        region = dilate(snapped, shape, steps, thin)
    return dilate(region, shape, erosion, mask) if erosion else region


def grow_until(seeds: DataFrame, limit: DataFrame, shape: tuple[int, int, int], most: int) -> DataFrame:
    """The seeds grown inside `limit` until a step adds nothing. A step is written before the next; a count reaches the
    driver. A region that still grows after `most` steps is a ValueError. A small volume that has no more voxels than `most`
    can't, so that there the seeds' components are taken at once."""
    if np.prod(shape) <= min(most, SMALL):
        return hanging(limit, dilate(seeds.select(*KEY), shape, 1, limit), shape)
    region, n = cut(seeds.select(*KEY)), -1
    for _ in range(most + 1):
        region = cut(dilate(region, shape, 1, limit))
        before, n = n, region.count()
        if n == before:
            return region
    raise ValueError(f"still growing after {most} steps")


def fill_slices(mask: DataFrame, shape: tuple[int, int, int], vols: DataFrame) -> DataFrame:
    """Each slice's mask with the background that doesn't touch the slice's border, joined by face neighbours in the slice."""
    nk, nj, ni = shape
    line = lambda n: F.explode(F.array(*[F.lit(x) for x in range(n)]))
    grid = vols.select("vol").distinct().withColumn("k", line(nk)).withColumn("j", line(nj)).withColumn("i", line(ni))
    labels = labelled(grid.join(mask, KEY, "left_anti"), shape, True)
    edge = (F.col("j") == 0) | (F.col("j") == nj - 1) | (F.col("i") == 0) | (F.col("i") == ni - 1)
    open_ = labels.where(edge).select("vol", "label").distinct()
    return mask.select(*KEY).unionByName(labels.join(open_, ["vol", "label"], "left_anti").select(*KEY))


def algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """op, vol, k, j, i: what two masks share ('and'), what only the first has ('minus') and what either has ('or'). One sum by
    volume and plane, each with the places of either mask in it, instead of a join for each."""
    both = a.select(*KEY, F.lit(1).alias("of")).unionByName(b.select(*KEY, F.lit(2).alias("of")))
    held = both.groupBy("vol", "k").agg(*[F.collect_set(F.when(F.col("of") == n, F.struct("j", "i"))).alias(c) for n, c in ((1, "a"), (2, "b"))])
    ops = {"and": F.array_intersect("a", "b"), "minus": F.array_except("a", "b"), "or": F.array_union("a", "b")}
    d = held.select("vol", "k", F.explode(F.array(*[F.struct(F.lit(n).alias("op"), x.alias("at")) for n, x in ops.items()])).alias("o"))
    return d.select("o.op", "vol", "k", F.explode("o.at").alias("p")).select("op", "vol", "k", "p.j", "p.i")


def reduce_blocks(grid: DataFrame, factors: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """Mean and maximum of blocks; what is left over at the far sides is dropped."""
    kept = grid
    for c, f, n in zip("kji", factors, shape):
        kept = kept.where(F.col(c) < n // f * f)
    blocks = [F.floor(F.col(c) / f).cast("int").alias(c) for c, f in zip("kji", factors)]
    return kept.groupBy("vol", *blocks).agg(F.avg("v").alias("mean"), F.max("v").alias("most"))


def recipe(grid: DataFrame, step: dict, shape: tuple[int, int, int], done: dict[str, DataFrame]) -> DataFrame:
    """One structure of a recipe, its parts in fixed order: range, exclusions, crowd filter, growth (or erosion, largest
    component and dilation), slice filling, dilation. Exclusions ('key+dil:N') name structures already done."""
    lo, hi = step.get("range", (None, None))
    kept = grid
    if lo is not None:
        kept = kept.where(F.col("v") > lo)
    if hi is not None:
        kept = kept.where(F.col("v") < hi)
    kept = kept.select(*KEY)
    for name in step.get("exclude", ()):
        key, _, n = name.partition("+dil:")
        if key not in done:
            raise ValueError(f"{key} isn't done yet")
        kept = kept.join(dilate(done[key], shape, int(n or 0)), KEY, "left_anti")
    if "crowd" in step:
        kept = keep_crowded(kept, step["crowd"], shape)
    r = step.get("erosion", 0)
    if "seeds" in step:
        out = grow(kept, step["seeds"], shape, r, step.get("steps"))
        if step.get("largest"):
            out = largest(labelled(out, shape))
    else:
        out = erode(kept, shape, r) if r else kept
        if step.get("largest"):
            out = largest(labelled(out, shape))
        out = dilate(out, shape, r, kept) if r else out
    if step.get("fill"):
        out = fill_slices(out, shape, grid.select("vol"))
    return dilate(out, shape, step["dilate"]) if step.get("dilate") else out
