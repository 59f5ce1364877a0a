"""Scene graphs: matrices composed along parents, and boxes united into every ancestor.

A node's matrix is composed by pointer doubling: each round joins every node with the ancestor that it has reached, so a
graph of depth d takes log2(d) joins, not d. Boxes go the other way by the same pointers: after round r a node's box holds
its descendants within 2^r levels. A round is written before the next; counts reach the driver.

nodes: scene, node, parent (null at a root; one that isn't there counts as none), matrix (16 numbers by rows), and low and
high (3 numbers each, null without a mesh).
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.lineage import cut

IDENTITY = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
GLB = """struct<scene: int, scenes: array<struct<nodes: array<int>>>, nodes: array<struct<name: string, mesh: int, children: array<int>,
  matrix: array<double>, translation: array<double>, rotation: array<double>, scale: array<double>>>,
  meshes: array<struct<primitives: array<struct<attributes: struct<POSITION: int>>>>>, accessors: array<struct<min: array<double>, max: array<double>>>>"""


def product(a: Column, b: Column) -> Column:
    """Of two matrices of 16 numbers by rows."""
    cell = lambda r, c: sum((F.get(a, F.lit(4 * r + k)) * F.get(b, F.lit(4 * k + c)) for k in range(1, 4)), F.get(a, F.lit(4 * r)) * F.get(b, F.lit(c)))
    return F.array(*[cell(i // 4, i % 4) for i in range(16)])


def placed(translation: Column, rotation: Column, scale: Column) -> Column:
    """Matrix of a translation, a unit quaternion (x, y, z, w) and a scale; each may be null."""
    t = [F.coalesce(F.get(translation, F.lit(i)), F.lit(0.0)) for i in range(3)]
    s = [F.coalesce(F.get(scale, F.lit(i)), F.lit(1.0)) for i in range(3)]
    x, y, z, w = (F.coalesce(F.get(rotation, F.lit(i)), F.lit(float(i == 3))) for i in range(4))
    turn = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
    rows = [[*(turn[r][c] * s[c] for c in range(3)), t[r]] for r in range(3)]
    return F.array(*[v for r in rows for v in r], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def moved_box(matrix: Column, low: Column, high: Column) -> Column:
    """struct low, high of a box's eight corners after a matrix: each of its terms is least, or most, at one end or the other."""
    ends = []
    for pick in (F.least, F.greatest):
        rows = []
        for r in range(3):
            m = [F.get(matrix, F.lit(4 * r + c)) for c in range(4)]
            rows.append(sum((pick(m[c] * F.get(low, F.lit(c)), m[c] * F.get(high, F.lit(c))) for c in range(3)), m[3]))
        ends.append(F.array(*rows))
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(ends[0].alias("low"), ends[1].alias("high")))


def world(nodes: DataFrame) -> DataFrame:
    """nodes with matrix as it stands in its scene, root (the topmost ancestor) and depth (0 at a root).

    A ring of parents is a ValueError. A node given twice is an error in the joins' results: give each once.
    """
    there = nodes.select("scene", F.col("node").alias("up"), F.lit(True).alias("there"))
    start = nodes.withColumn("up", F.col("parent")).join(there.hint("merge"), ["scene", "up"], "left")
    d = cut(start.select("scene", "node", "matrix", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), F.col("up")).alias("over"), F.col("there").isNotNull().cast("int").alias("depth")))
    total = d.count()
    for _ in range(ceil(log2(total + 1)) + 1):
        if d.where("up is not null").isEmpty():
            break
        above = d.select("scene", F.col("node").alias("up"), F.col("matrix").alias("m"), F.col("up").alias("next"), F.col("over").alias("top"), F.col("depth").alias("more"))
        j = d.join(above.hint("merge"), ["scene", "up"], "left")
        far = F.col("up").isNotNull()
        d = cut(j.select("scene", "node", F.when(far, product(F.col("m"), F.col("matrix"))).otherwise(F.col("matrix")).alias("matrix"), F.col("next").alias("up"), F.when(far, F.coalesce("top", "up")).otherwise(F.col("over")).alias("over"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    else:
        if not d.where("up is not null").isEmpty():
            raise ValueError("the parents of some nodes form a ring")
    own = d.select("scene", "node", F.col("matrix").alias("placed"), F.coalesce("over", "node").alias("root"), "depth")
    return nodes.join(own.hint("merge"), ["scene", "node"]).withColumn("matrix", F.col("placed")).drop("placed")


def boxes(nodes: DataFrame) -> DataFrame:
    """scene, node, low, high in the scene's axes, over a node's own mesh and all below it; null where there is none.
    nodes: as world() gives them."""
    box = moved_box(F.col("matrix"), F.col("low"), F.col("high"))
    parts = [F.get(box.getField(e), F.lit(c)).alias(f"{e}_{c}") for e in ("low", "high") for c in range(3)]
    d = cut(nodes.select("scene", "node", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), *parts))
    low, high = [f"low_{c}" for c in range(3)], [f"high_{c}" for c in range(3)]
    while not d.where("up is not null").isEmpty():
        below = d.where("up is not null").groupBy("scene", F.col("up").alias("node")).agg(*[F.min(c).alias(f"b_{c}") for c in low], *[F.max(c).alias(f"b_{c}") for c in high])
        above = d.select("scene", F.col("node").alias("up"), F.col("up").alias("next"))
        j = d.join(below.hint("merge"), ["scene", "node"], "left").join(above.hint("merge"), ["scene", "up"], "left")
        d = cut(j.select("scene", "node", F.col("next").alias("up"), *[F.least(c, f"b_{c}").alias(c) for c in low], *[F.greatest(c, f"b_{c}").alias(c) for c in high]))
    given = F.col("low_0").isNotNull()
    return d.select("scene", "node", F.when(given, F.array(*low)).alias("low"), F.when(given, F.array(*high)).alias("high"))


def glb_document(content: Column) -> Column:
    """The JSON text of a binary glTF 2 file; null if it isn't one."""
    number = lambda at: F.conv(F.hex(F.concat(*[F.substring(content, at + i, 1) for i in (3, 2, 1, 0)])), 16, 10).cast("int")
    good = (F.length(content) >= 20) & (F.hex(F.substring(content, 1, 4)) == F.lit("676C5446")) & (number(5) == 2) & (F.hex(F.substring(content, 17, 4)) == F.lit("4A534F4E"))
    return F.when(good, F.decode(content.substr(F.lit(21), number(13)), "UTF-8"))


def glb_nodes(files: DataFrame, scene: str = "path", document: str = "document") -> DataFrame:
    """nodes (and their names) of the default scene of glTF documents: a file's matrices, parents and mesh boxes. A node without
    a name is node_ and its number; a document that isn't JSON has none."""
    g = files.select(F.col(scene).alias("scene"), F.from_json(document, GLB).alias("g")).where("g.nodes is not null")
    each = g.select("scene", "g", F.posexplode("g.nodes").alias("node", "n"))
    mesh = F.get(F.col("g.meshes"), F.col("n.mesh")).getField("primitives")
    edge = lambda e: F.transform(mesh, lambda p: F.get(F.col("g.accessors"), p.getField("attributes").getField("POSITION")).getField(e))
    along = lambda e, c: F.transform(edge(e), lambda x: F.get(x, F.lit(c)))
    side = lambda pick, e: F.when(F.size(F.filter(edge(e), lambda x: x.isNotNull())) > 0, F.array(*[pick(along(e, c)) for c in range(3)]))
    across = F.array(*[F.get(F.col("n.matrix"), F.lit(i % 4 * 4 + i // 4)) for i in range(16)])  # a file has columns first
    matrix = F.when(F.col("n.matrix").isNotNull(), across).otherwise(placed(F.col("n.translation"), F.col("n.rotation"), F.col("n.scale")))
    own = each.select("scene", "node", F.coalesce("n.name", F.concat(F.lit("node_"), F.col("node"))).alias("name"), matrix.alias("matrix"), side(F.array_min, "min").alias("low"), side(F.array_max, "max").alias("high"))
    up = each.select("scene", F.col("node").alias("parent"), F.explode("n.children").alias("node"))
    tops = g.select("scene", F.coalesce(F.get(F.col("g.scenes"), F.coalesce("g.scene", F.lit(0))).getField("nodes"), F.sequence(F.lit(0), F.size("g.nodes") - 1)).alias("tops"))
    held = world(own.join(up, ["scene", "node"], "left")).join(tops, "scene")
    return held.where(F.array_contains("tops", F.col("root"))).drop("tops")
