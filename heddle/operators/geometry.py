"""Vectors, affine maps, polylines and meshes over columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Vector = list[Column]


def dot(a: Vector, b: Vector) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(x: Column, y: Column, z: Column) -> Vector:
    """Length one; a zero vector stays."""
    n = norm([x, y, z])
    n = F.when(n == 0, 1.0).otherwise(n)
    return [x / n, y / n, z / n]


def to_patient(kji: Vector, origin: list[float], spacing: list[float], cosines: list[float], normal: list[float]) -> Vector:
    """mm of a voxel: origin + i dx row + j dy column + k dz normal."""
    k, j, i = kji
    return [F.lit(o) + i * (spacing[2] * r) + j * (spacing[1] * c) + k * (spacing[0] * n) for o, r, c, n in zip(origin, cosines[:3], cosines[3:], normal)]


def to_voxel(p: Vector, origin: list[float], spacing: list[float], cosines: list[float], normal: list[float]) -> Vector:
    """The way back, for orthonormal axes."""
    d = [x - o for x, o in zip(p, origin)]
    return [sum((a * b for a, b in zip(d[1:], v[1:])), d[0] * v[0]) / s for v, s in ((normal, spacing[0]), (cosines[3:], spacing[1]), (cosines[:3], spacing[2]))]


def to_full(reduced: Column, first: float, factor: int) -> Column:
    """Index in the full grid of a block's centre."""
    return F.lit(first) + reduced * factor + (factor - 1) / 2


def to_reduced(full: Column, first: float, factor: int) -> Column:
    return (full - first - (factor - 1) / 2) / factor


def to_gltf(b: Vector) -> Vector:
    """(x, y, z) with z up to y up."""
    return [b[0], b[2], -b[1]]


def nearest_segment(points: DataFrame, segments: DataFrame, pkey: list[str], skey: str = "n", axes: str = "xyz") -> DataFrame:
    """points: pkey and px, py, pz; segments (a polyline, small): path, n, s, ax.., bx.. . Per point the distance to the
    polyline of the same `path`, the length s along it and whether the foot was cut off at either end (tip). Of equal
    distances the first segment wins."""
    a = [F.col(f"a{c}") for c in axes]
    p = [F.col(f"p{c}") for c in axes]
    ab = [F.col(f"b{c}") - F.col(f"a{c}") for c in axes]
    l2 = dot(ab, ab)
    raw = F.when(l2 > 0, dot([x - y for x, y in zip(p, a)], ab) / l2).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    d = norm([x - (y + t * z) for x, y, z in zip(p, a, ab)])
    every = Window.partitionBy("path")
    seg = segments.withColumn("__last", F.max(skey).over(every)).withColumn("__first", F.min(skey).over(every))
    tip = ((F.col(skey) == F.col("__first")) & (raw < 0)) | ((F.col(skey) == F.col("__last")) & (raw > 1))
    one = points.join(seg, "path").select(*pkey, F.struct(d.alias("d"), F.col(skey).alias("n"), (F.col("s") + t * F.sqrt(l2)).alias("s"), tip.alias("tip")).alias("m"))
    return one.groupBy(*pkey).agg(F.min("m").alias("m")).select(*pkey, F.col("m.d").alias("distance"), F.col("m.s").alias("s"), F.col("m.tip").alias("tip"))


def subdivide(segments: DataFrame, step: float, axes: str = "xyz") -> DataFrame:
    """Points from each segment's start on, at most `step` apart, its end left out: path, n, t and coordinates."""
    ab = [F.col(f"b{c}") - F.col(f"a{c}") for c in axes]
    parts = F.greatest(F.lit(1), F.ceil(norm(ab) / step))
    d = segments.withColumn("__m", parts).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    return d.select("path", "n", "t", *[(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.col("t") / F.col("__m")).alias(c) for c in axes])


def catmull_rom(points: DataFrame, per: int, order: list[str], axes: str = "xyz", alpha: float = 0.5) -> DataFrame:
    """Centripetal spline through each path's points: `per` samples from each point on, its next left out. The ends are mirrored."""
    w = Window.partitionBy("path").orderBy(*order)
    d = points.select("path", F.row_number().over(w).alias("n"), *axes, *[F.lead(c).over(w).alias(f"{c}2") for c in axes], *[F.lag(c).over(w).alias(f"{c}0") for c in axes], *[F.lead(c, 2).over(w).alias(f"{c}3") for c in axes])
    d = d.where(F.col(f"{axes[0]}2").isNotNull())
    p1, p2 = [F.col(c) for c in axes], [F.col(f"{c}2") for c in axes]
    d = d.select("path", "n", *axes, *[f"{c}2" for c in axes], *[F.coalesce(F.col(f"{c}0"), 2 * a - b).alias(f"{c}0") for c, a, b in zip(axes, p1, p2)], *[F.coalesce(F.col(f"{c}3"), 2 * b - a).alias(f"{c}3") for c, a, b in zip(axes, p1, p2)])
    p = [[F.col(f"{c}{i}") for c in axes] for i in ("0", "", "2", "3")]
    gap = lambda a, b: F.greatest(F.pow(norm([x - y for x, y in zip(b, a)]), F.lit(alpha)), F.lit(1e-9))
    d = d.select("*", gap(p[0], p[1]).alias("__a"), gap(p[1], p[2]).alias("__b"), gap(p[2], p[3]).alias("__c")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    t0, t1 = F.lit(0.0), F.col("__a")
    t2, t3 = t1 + F.col("__b"), t1 + F.col("__b") + F.col("__c")
    t = t1 + F.col("__b") * F.col("m") / per
    mix = lambda a, b, ta, tb: (tb - t) / (tb - ta) * a + (t - ta) / (tb - ta) * b
    out = []
    for i, c in enumerate(axes):
        q = [v[i] for v in p]
        a1, a2, a3 = mix(q[0], q[1], t0, t1), mix(q[1], q[2], t1, t2), mix(q[2], q[3], t2, t3)
        out.append(mix(mix(a1, a2, t0, t2), mix(a2, a3, t1, t3), t1, t2).alias(c))
    return d.select("path", "n", "m", *out)


def lookup(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear between knots, the end values outside."""
    out = F.when(x <= knots[0][0], knots[0][1])
    for (a, u), (b, v) in zip(knots, knots[1:]):
        out = out.when(x <= b, u + (v - u) * (x - a) / (b - a))
    return out.otherwise(knots[-1][1])


def signed_volume(triangles: DataFrame, by: str) -> DataFrame:
    """Sum of a . (b x c) / 6 over a mesh's triangles (ax .. cz)."""
    a, b, c = ([F.col(f"{p}{x}") for x in "xyz"] for p in "abc")
    return triangles.groupBy(by).agg((F.sum(dot(a, cross(b, c))) / 6).alias("volume"))


def unique_edges(faces: DataFrame, by: str, corners: list[str]) -> DataFrame:
    """The different sides of polygons, smaller corner first."""
    sides = F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in zip(corners, corners[1:] + corners[:1])])
    return faces.select(by, F.explode(sides).alias("e")).select(by, "e.a", "e.b").distinct()
