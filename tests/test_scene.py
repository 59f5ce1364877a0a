"""Scene graphs against plain recursion, and a binary file end to end."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import scene as G

NODES = "scene string, node int, parent int, matrix array<double>, low array<double>, high array<double>"


def plain(rows):
    by = {(s, n): (p, np.array(m).reshape(4, 4), lo, hi) for s, n, p, m, lo, hi in rows}
    full, root, depth, box = {}, {}, {}, {}

    def up(key):
        if key not in full:
            p, m, _, _ = by[key]
            above = (key[0], p)
            if p is None or above not in by:
                full[key], root[key], depth[key] = m, key[1], 0
            else:
                up(above)
                full[key], root[key], depth[key] = full[above] @ m, root[above], depth[above] + 1
        return full[key]

    for key in by:
        up(key)
    for key, (p, _, lo, hi) in by.items():
        if lo is None:
            continue
        corners = np.array([full[key] @ [x, y, z, 1] for x in (lo[0], hi[0]) for y in (lo[1], hi[1]) for z in (lo[2], hi[2])])[:, :3]
        at = key
        while at in by:
            old = box.get(at, (np.full(3, np.inf), np.full(3, -np.inf)))
            box[at] = np.minimum(old[0], corners.min(axis=0)), np.maximum(old[1], corners.max(axis=0))
            at = (at[0], by[at][0])
    return full, root, depth, box


def made(n, deep, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        p = None if i % 50 == 0 else i - 1 if i < deep else int(rng.integers(max(0, i - 50), i))
        m = np.eye(4)
        m[:3] += rng.normal(0, 0.2, (3, 4))
        mesh = rng.random() < 0.4
        rows.append(("s", i, p, [float(x) for x in m.ravel()], [float(x) for x in rng.normal(-1, 1, 3)] if mesh else None, [1.0, 2.0, 3.0] if mesh else None))
    return rows


def test_matrices_and_boxes_equal_recursion_at_any_depth(spark):
    rows = [*made(120, 49, 1), ("t", 5, 99, G.IDENTITY, [0.0] * 3, [1.0] * 3), ("t", 6, 5, G.IDENTITY, None, None), ("u", 0, None, G.IDENTITY, None, None)]
    full, root, depth, box = plain(rows)
    d = G.world(spark.createDataFrame(rows, NODES).repartition(3))
    got = d.collect()
    assert len(got) == len(rows) and max(depth.values()) >= 30
    for r in got:
        key = (r.scene, r.node)
        assert np.allclose(np.array(r.matrix).reshape(4, 4), full[key]) and (r.root, r.depth) == (root[key], depth[key])
    found = {(r.scene, r.node): (r.low, r.high) for r in G.boxes(d).collect()}
    assert len(found) == len(rows)
    for key, (lo, hi) in found.items():
        assert (lo is None) == (key not in box)
        if lo is not None:
            assert np.allclose(lo, box[key][0]) and np.allclose(hi, box[key][1])


def test_a_ring_is_an_error(spark):
    for ring in ([(0, 1), (1, 0)], [(0, None), (1, 2), (2, 3), (3, 1)], [(0, 0)]):
        rows = [("s", n, p, G.IDENTITY, None, None) for n, p in ring]
        with pytest.raises(ValueError):
            G.world(spark.createDataFrame(rows, NODES))
    assert G.world(spark.createDataFrame([], NODES)).collect() == []


def glb(document):
    text = json.dumps(document).encode()
    text += b" " * (-len(text) % 4)
    return b"glTF" + struct.pack("<II", 2, 20 + len(text)) + struct.pack("<I", len(text)) + b"JSON" + text


def test_a_binary_file_gives_nodes_and_boxes(spark):
    document = {
        "scene": 0, "scenes": [{"nodes": [0]}],
        "nodes": [{"name": "top", "children": [1, 2], "translation": [1, 2, 3]}, {"mesh": 0, "scale": [2, 1, 1]}, {"name": "turned", "mesh": 1, "matrix": [0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1, 0, 5, 0, 0, 1]}, {"name": "unused", "mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}, {"attributes": {"POSITION": 1}}]}, {"primitives": [{"attributes": {"POSITION": 0}}]}],
        "accessors": [{"min": [0, 0, 0], "max": [1, 1, 1]}, {"min": [-1, 0, 0], "max": [0, 2, 0.5]}],
    }
    files = spark.createDataFrame([("a", bytearray(glb(document))), ("b", bytearray(b"no such file")), ("c", bytearray(b""))], "path string, content binary")
    read = files.select("path", G.glb_document(F.col("content")).alias("document"))
    assert {r.path: r.document is None for r in read.collect()} == {"a": False, "b": True, "c": True}
    nodes = G.glb_nodes(read)
    names = {r.node: r.name for r in nodes.collect()}
    assert names == {0: "top", 1: "node_1", 2: "turned"}
    box = {r.node: (r.low, r.high) for r in G.boxes(nodes).collect()}
    assert box[1] == ([-1, 2, 3], [3, 4, 4]) and box[2] == ([5, 2, 3], [6, 3, 4]) and box[0] == ([-1, 2, 3], [6, 4, 4])
