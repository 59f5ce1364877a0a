"""Courses against plain loops over dense volumes with bends, gaps, branches and way points."""

import math

import numpy as np
import pytest

from heddle.operators import lumen as L

SPACING = (2.0, 1.0, 0.5)


def mean9(img):
    p = np.pad(img, 1, mode="edge")
    return sum(p[a : a + img.shape[0], b : b + img.shape[1]] for a in range(3) for b in range(3)) / 9


def parts(mask):
    """Components of a plane as sets of cells, in the order of their first cells."""
    left, out = {tuple(map(int, p)) for p in np.argwhere(mask)}, []
    for cell in sorted(left):
        if cell in left:
            own, todo = set(), [cell]
            left.discard(cell)
            while todo:
                a, b = todo.pop()
                own.add((a, b))
                for n in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if n in left:
                        left.discard(n)
                        todo.append(n)
            out.append(own)
    return out


def plain_course(v, axis, lo, hi, least, jump, smooth, way):
    x = "kji".index(axis)
    others = [n for n in range(3) if n != x]
    v = np.moveaxis(v, x, 0)
    ea, eb = (SPACING[n] for n in others)
    centre = lambda own: tuple(np.mean(sorted(own), axis=0))
    cand = []
    for img in v:
        m = mean9(img)
        cand.append([p for p in parts((m > lo if lo is not None else True) & (m < hi if hi is not None else True) & np.ones(m.shape, bool)) if len(p) >= least])
    points = {round(p[x]): tuple(float(p[n]) for n in others) for p in way}
    chosen, last, at = {}, None, None
    for s, own in enumerate(cand):
        pick = None
        aim = points.get(s, at)
        if own and last and s not in points:
            shared = [len(p & last) for p in own]
            pick = own[shared.index(max(shared))] if max(shared) else None
        if own and pick is None and aim:
            far = [math.hypot((centre(p)[0] - aim[0]) * ea, (centre(p)[1] - aim[1]) * eb) for p in own]
            pick = own[far.index(min(far))] if min(far) <= jump else None
        if own and pick is None and not aim:
            pick = max(own, key=len)
        last = pick
        if pick:
            chosen[s], at = pick, centre(pick)
        elif s in points:
            at = points[s]
    known = sorted({*chosen, *points})
    if not known:
        return []
    rows = []
    for s in range(known[0], known[-1] + 1):
        rows.append([s, *(centre(chosen[s]) if s in chosen else points.get(s, (math.nan, math.nan))), len(chosen.get(s, ())), s not in chosen, s not in chosen and s in points])
    f = np.array([r[:3] for r in rows], float)
    for c in (1, 2):
        ok = ~np.isnan(f[:, c])
        f[:, c] = np.interp(f[:, 0], f[ok, 0], f[ok, c])
    soft = f[:, 1:].copy()
    if smooth > 1 and len(f) >= 3:
        for n in range(len(f)):
            soft[n] = f[max(0, n - smooth // 2) : n + smooth // 2 + 1, 1:].mean(axis=0)
    forced = np.array([r[5] for r in rows])
    soft[forced] = f[forced, 1:]
    p = np.zeros((len(f), 3))
    p[:, x], p[:, others] = f[:, 0], soft
    mm = p * SPACING
    t = np.gradient(mm, axis=0) if len(p) > 1 else np.array([[0.0, 0.0, 1.0]])
    t = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9)
    radius = [0.0 if r[4] else math.sqrt(r[3] * ea * eb * abs(t[n, x]) / math.pi) for n, r in enumerate(rows)]
    s_mm = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(mm, axis=0), axis=1))])
    return [(n, *p[n], s_mm[n], radius[n], bool(r[4]), bool(r[5])) for n, r in enumerate(rows)]


def tube(shape, seed, gaps):
    """A bent tube along k with slices missing, a side branch and noise."""
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.15, shape)
    for k in range(shape[0]):
        if k in gaps:
            continue
        for (cj, ci), r in (((6 + 3 * math.sin(k / 3), 8 + k / 3), 2.5), ((14, 4 + k % 3), 1.6)):
            j, i = np.ogrid[: shape[1], : shape[2]]
            v[k][(j - cj) ** 2 + (i - ci) ** 2 <= r * r] += 1
    return v


def table(spark, volumes):
    rows = [(v, *map(int, p), float(a[tuple(p)])) for v, a in volumes.items() for p in np.argwhere(np.ones(a.shape))]
    return spark.createDataFrame(rows, "vol long, k int, j int, i int, v double").repartition(4)


@pytest.fixture(scope="module")
def volumes(spark):
    own = {1: tube((14, 18, 20), 1, {5, 6}), 2: tube((14, 18, 20), 2, {0, 9}), 3: np.zeros((14, 18, 20)), 4: tube((14, 18, 20), 4, set(range(13)))}
    return own, table(spark, own).cache()


@pytest.mark.parametrize("axis,jump,smooth", [("k", 3.0, 5), ("k", 12.0, 1), ("j", 4.0, 3), ("i", 2.0, 4)])
def test_courses_equal_plain_loops(spark, volumes, axis, jump, smooth):
    own, grid = volumes
    way = {1: [(6, 13.0, 5.0), (9.5, 14.0, 4.0)], 2: [(0, 6.0, 8.0), (12, 1.0, 19.0)], 3: [(2, 3, 4), (6, 7, 8)]}
    points = spark.createDataFrame([(v, n, *map(float, p)) for v, ps in way.items() for n, p in enumerate(ps)], "vol long, n int, k double, j double, i double")
    found = L.pieces(grid, axis, 0.5, None, 3)
    for given, table_ in ((way, points), ({}, None)):
        got = {}
        for r in L.course(L.follow(found, table_, axis, jump, SPACING), axis, smooth, SPACING).collect():
            got.setdefault(r.vol, []).append((r.n, r.k, r.j, r.i, r.s_mm, r.radius, r.gap, r.forced))
        for v, a in own.items():
            want = plain_course(a, axis, 0.5, None, 3, jump, smooth, given.get(v, []))
            mine = sorted(got.get(v, []))
            assert len(mine) == len(want), (v, given)
            for x, y in zip(mine, want):
                assert x[0] == y[0] and x[6:] == y[6:] and np.allclose(x[1:6], y[1:6], atol=1e-9), (v, x, y)


def test_points_between_keep_the_corners(spark):
    points = spark.createDataFrame([(1, 5, 0.0, 0.0, 0.0), (1, 7, 0.0, 10.0, 0.0), (1, 9, 2.0, 10.0, 3.0), (2, 0, 1.0, 1.0, 1.0)], "vol long, n int, k double, j double, i double")
    got = [tuple(r) for r in L.between(points, 3.0, SPACING).orderBy("vol", "leg", "t").collect()]
    assert [g[3:] for g in got if g[2] == 0] == [(0, 0, 0), (0, 10, 0), (2, 10, 3), (1, 1, 1)]
    assert [g[4] for g in got if g[:2] == (1, 1)] == [0, 2.5, 5, 7.5]
    for a, b in zip(got, got[1:]):
        if a[0] == b[0]:
            assert math.dist([x * y for x, y in zip(a[3:], SPACING)], [x * y for x, y in zip(b[3:], SPACING)]) <= 3 + 1e-9


def test_radii_by_points_equal_plain_windows(spark, volumes):
    own, grid = volumes
    shape, window, search = (14, 18, 20), 3.0, 2.0
    way = {v: [(1, 6.0, 8.5), (7, 9.0, 10.0), (13, 14.0, 5.0), (20, 14.0, 5.0)] for v in own}
    points = spark.createDataFrame([(v, n, *map(float, p)) for v, ps in way.items() for n, p in enumerate(ps)], "vol long, n int, k double, j double, i double")
    got = {}
    for r in L.by_points(grid, points, "k", 0.5, None, shape, 1.5, SPACING, window, search).collect():
        got.setdefault(r.vol, []).append(r)
    seen_gap = False
    for v, a in own.items():
        mine = sorted(got[v], key=lambda r: r.n)
        p = np.array([(r.k, r.j, r.i) for r in mine])
        t = np.gradient(p * SPACING, axis=0)
        t /= np.linalg.norm(t, axis=1, keepdims=True)
        for n, r in enumerate(mine):
            k, j, i = (int(np.round(x)) for x in p[n])
            area = 0
            if 0 <= k < shape[0]:
                lo_j, lo_i = max(0, j - int(window / SPACING[1])), max(0, i - int(window / SPACING[2]))
                img = a[k, lo_j : j + int(window / SPACING[1]) + 1, lo_i : i + int(window / SPACING[2]) + 1]
                found = parts(mean9(img) > 0.5)
                near = sorted((math.hypot((c[0] + lo_j - j) * SPACING[1], (c[1] + lo_i - i) * SPACING[2]), c) for q in found for c in q)
                if near and near[0][0] <= search:
                    area = next(len(q) for q in found if near[0][1] in q)
            want = math.sqrt(area * SPACING[1] * SPACING[2] * abs(t[n, 0]) / math.pi)
            assert math.isclose(r.radius, want, abs_tol=1e-9) and r.gap == (want <= 0), (v, n)
            seen_gap |= r.gap
        s = L.summary(spark.createDataFrame(mine)).first()
        assert s.points == len(mine) and math.isclose(s.length, mine[-1].s_mm) and (s.gaps > 0) == any(r.gap for r in mine)
    assert seen_gap
