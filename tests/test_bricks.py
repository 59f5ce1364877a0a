"""Bricks against dense numpy arrays and the row forms, on odd shapes and borders."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import bricks as B
from heddle.operators import voxels as V


def rows_of(masks):
    return [(v, *map(int, p)) for v, m in masks.items() for p in np.argwhere(m)]


def dense(rows, shape):
    out = {}
    for v, k, j, i, *_ in rows:
        out.setdefault(v, np.zeros(shape, bool))[k, j, i] = True
    return out


def erode(m, n=1):
    for _ in range(n):
        p = np.pad(m, 1, constant_values=True)
        m = m & p[2:, 1:-1, 1:-1] & p[:-2, 1:-1, 1:-1] & p[1:-1, 2:, 1:-1] & p[1:-1, :-2, 1:-1] & p[1:-1, 1:-1, 2:] & p[1:-1, 1:-1, :-2]
    return m


def dilate(m, n=1, limit=None):
    for _ in range(n):
        p = np.pad(m, 1)
        m = m | p[2:, 1:-1, 1:-1] | p[:-2, 1:-1, 1:-1] | p[1:-1, 2:, 1:-1] | p[1:-1, :-2, 1:-1] | p[1:-1, 1:-1, 2:] | p[1:-1, 1:-1, :-2]
        m = m if limit is None else m & limit
    return m


@pytest.fixture(scope="module")
def masks(spark):
    rng = np.random.default_rng(8)
    shape = (7, 11, 5)
    own = {1: rng.random(shape) < 0.75, 2: rng.random(shape) < 0.05, 9: np.ones(shape, bool)}
    return shape, own, spark.createDataFrame(rows_of(own), "vol long, k int, j int, i int").repartition(3)


@pytest.mark.parametrize("side", [3, 4, 16])
def test_chains_equal_dense_arrays(spark, masks, side):
    shape, own, df = masks
    held = B.bricks(df, side, F.lit(3))
    cases = {
        "dilate": ([("dilate", 2)], lambda m: dilate(m, 2)),
        "erode": ([("erode", 3)], lambda m: erode(m, 3)),
        "contour": ([("contour",)], lambda m: m & ~erode(m)),
        "open": ([("erode", 1), ("dilate_within", 2)], lambda m: dilate(erode(m), 2, m)),
        "thick": ([("dilate", 1), ("contour",)], lambda m: dilate(m) & ~erode(dilate(m))),
    }
    for name, (steps, plain) in cases.items():
        got = dense(B.voxels(B.filtered(held, steps, shape, side), side).collect(), shape)
        for v, m in own.items():
            assert (got.get(v, np.zeros(shape, bool)) == plain(m)).all(), (name, v)
    crowd = dense(B.voxels(B.filtered(held, [("crowd", 14)], shape, side), side).collect(), shape)
    for v, m in own.items():
        p = np.pad(m.astype(int), 1)
        n = sum(p[a : a + 7, b : b + 11, c : c + 5] for a in range(3) for b in range(3) for c in range(3))
        assert (crowd.get(v, np.zeros(shape, bool)) == (m & (n >= 14))).all()


def test_bricks_equal_the_row_forms(spark, masks):
    shape, _, df = masks
    same = lambda a, b: sorted(map(tuple, a.select(*V.KEY).collect())) == sorted(map(tuple, b.select(*V.KEY).collect()))
    held = B.bricks(df, 4)
    assert same(B.voxels(B.filtered(held, [("dilate", 1)], shape, 4), 4), V.dilate(df, shape))
    assert same(B.voxels(B.filtered(held, [("erode", 2)], shape, 4), 4), V.erode(df, shape, 2))
    assert same(B.voxels(B.filtered(held, [("crowd", 9)], shape, 4), 4), V.keep_crowded(df, 9, shape))


@pytest.mark.parametrize("mode,pad", [("constant", "constant"), ("edge", "edge"), ("wrap", "wrap")])
def test_box_sums_equal_dense_arrays(spark, mode, pad):
    rng = np.random.default_rng(4)
    for shape, side in (((5, 7, 9), 4), ((3, 3, 3), 8), ((1, 6, 2), 3)):
        own = rng.normal(0, 1, shape)
        df = spark.createDataFrame([(0, *map(int, p), float(own[tuple(p)])) for p in np.argwhere(np.ones(shape))], "vol long, k int, j int, i int, v double")
        p = np.pad(own, 1, mode=pad)
        want = sum(p[a : a + shape[0], b : b + shape[1], c : c + shape[2]] for a in range(3) for b in range(3) for c in range(3))
        got = np.zeros(shape)
        rows = B.voxels(B.filtered(B.bricks(df, side), [("sum",)], shape, side, mode), side).collect()
        assert len(rows) == own.size
        for r in rows:
            got[r.k, r.j, r.i] = r.v
        assert np.allclose(got, want)


def exchanges(df):
    return len(re.findall(r"\bExchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_only_slabs_are_exchanged_and_only_bricks_of_a_box_are_read(spark, masks):
    shape, own, df = masks
    spark.sql("DROP TABLE IF EXISTS heddle_bricks")
    held = B.save_bricks(B.bricks(df, 4), "heddle_bricks", 4)
    try:
        out = B.filtered(held, [("dilate", 1)], shape, 4)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert exchanges(out) == 1, plan
        assert "SortMergeJoin" in plan
        assert sum(m.sum() for m in dense(B.voxels(out, 4).collect(), shape).values()) == sum(dilate(m).sum() for m in own.values())
        part = B.box(held, 1, [(2, 6), (0, 3), (4, 5)], 4)
        assert sorted((r.k, r.j, r.i) for r in part.collect()) == [tuple(map(int, p)) for p in np.argwhere(own[1]) if 2 <= p[0] < 6 and p[1] < 3 and p[2] == 4]
        spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
        pushed = held.where("vol = 1 AND bk BETWEEN 0 AND 1")._jdf.queryExecution().executedPlan().toString()
        part = B.box(held, 1, [(2, 6), (0, 3), (4, 5)], 4)._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        for x in ("EqualTo(vol,1)", "GreaterThanOrEqual(bk,0)", "LessThanOrEqual(bk,1)"):
            assert x in pushed and x in part, part
    finally:
        spark.sql("DROP TABLE IF EXISTS heddle_bricks")


def test_reach_is_checked_and_empty_masks_stay_empty(spark, masks):
    shape, _, df = masks
    with pytest.raises(ValueError):
        B.filtered(B.bricks(df, 3), [("erode", 4)], shape, 3)
    with pytest.raises(ValueError):
        B.filtered(B.bricks(df, 3), [("melt", 1)], shape, 3)
    with pytest.raises(ValueError):
        B.reach([("sum",), ("dilate", 1)])
    assert B.filtered(B.bricks(df.limit(0), 3), [("dilate", 1)], shape, 3).collect() == []


def test_seeds_move_within_reach_only_and_growth_that_goes_on_is_told(spark):
    line = spark.createDataFrame([(1, 0, 0, i) for i in range(12)] + [(2, 0, 0, 11)], "vol long, k int, j int, i int")
    shape = (1, 1, 12)
    seeds = spark.createDataFrame([(1, 0, 0, 3), (2, 0, 0, 3)], "vol long, k int, j int, i int")
    assert {(r.vol, r.i) for r in V.grow(line, seeds, shape).collect()} == {(1, i) for i in range(12)}
    assert {(r.vol, r.i) for r in V.grow(line, seeds, shape, reach=(0, 0, 8)).collect()} == {(1, i) for i in range(12)} | {(2, 11)}
    own = seeds.where("vol = 1")
    assert V.grow_until(own, line, shape, 8).count() == 12
    with pytest.raises(ValueError):
        V.grow_until(own, line, shape, 4)
