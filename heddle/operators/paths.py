"""Folds along a path that windows can't express: following a lumen from slice to slice, carrying a frame along a curve.

A volume is one group of applyInPandas, its state the previous slice's piece; paths pass by in batches, with the previous frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def follow(pieces: DataFrame, jump: float) -> DataFrame:
    """pieces: vol, slice, piece, cells (sorted places in the slice), ca, cb. Returns vol, slice, piece, gap for every slice from
    the first followed to the last.

    In each slice the piece that shares most cells with the one before is followed (of equals the smallest number); else
    the nearest within `jump` of the last centre; else, before any centre is known, the one with most cells. A slice
    without one is a gap, after which only nearness counts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {s: g.sort_values("piece") for s, g in pdf.groupby("slice")}
        held, centre, out = None, None, {}
        for s in range(min(by), max(by) + 1):
            g, pick = by.get(s), None
            if g is not None:
                if held is not None:
                    shared = [len(held & set(c)) for c in g["cells"]]
                    pick = int(np.argmax(shared)) if max(shared) else None
                if pick is None and centre is not None:
                    d = np.hypot(g["ca"] - centre[0], g["cb"] - centre[1]).to_numpy()
                    pick = int(d.argmin()) if d.min() <= jump else None
                elif pick is None and centre is None:
                    pick = int(np.argmax([len(c) for c in g["cells"]]))
            if pick is None:
                held = None
                continue
            row = g.iloc[pick]
            held, centre, out[s] = set(row["cells"]), (row["ca"], row["cb"]), int(row["piece"])
        if not out:
            return pd.DataFrame({"vol": [], "slice": [], "piece": [], "gap": []})
        span = range(min(out), max(out) + 1)
        return pd.DataFrame({"vol": pdf["vol"].iloc[0], "slice": list(span), "piece": [out.get(s, -1) for s in span], "gap": [s not in out for s in span]})

    return pieces.groupBy("vol").applyInPandas(run, "vol long, slice int, piece long, gap boolean")


def frames(points: DataFrame) -> DataFrame:
    """points: path, n, x, y, z. Adds a unit normal (nx, ny, nz) to each, carried along without twist: the normal before, less
    its part along the new tangent. The first is the axis least along the first tangent.

    Tangents come from a window over each path. Rows then pass by in order: the paths of a batch are folded side by side, step
    by step, and what goes from batch to batch is the last normal."""
    w = Window.partitionBy("path").orderBy("n")
    before, after = ({c: f(c).over(w) for c in "xyz"} for f in (F.lag, F.lead))
    first = F.row_number().over(w) == 1
    one = F.lag("n").over(w).isNull() & F.lead("n").over(w).isNull()
    # half the way from the point before to the one after, at an end the way to or from its neighbour
    way = {c: F.coalesce((after[c] - before[c]) / 2, after[c] - F.col(c), F.col(c) - before[c], F.when(one, F.lit(float(c == "z")))) for c in "xyz"}
    d = points.select("path", "n", *[F.col(c).cast("double").alias(c) for c in "xyz"], *[v.alias(f"t{c}") for c, v in way.items()], first.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((1, 3))
        for b in batches:
            if not b.num_rows:
                continue
            t = np.stack([b.column(f"t{c}").to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], axis=1)
            t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9)
            new = b.column("first").to_numpy(zero_copy_only=False).astype(bool)
            starts = np.flatnonzero(new | (np.arange(len(t)) == 0))
            length = np.diff(np.append(starts, len(t)))
            held = np.eye(3)[np.abs(t[starts]).argmin(axis=1)]
            if not new[0]:
                held[0] = last
            order = np.argsort(-length, kind="stable")
            starts, length, held = starts[order], length[order], held[order]
            normals = np.empty_like(t)
            alive = len(starts) - np.searchsorted(length[::-1], np.arange(1, length[0] + 1))  # paths with more than so many points
            for k, m in enumerate(alive):
                at = starts[:m] + k
                side = held[:m] - (held[:m] * t[at]).sum(axis=1, keepdims=True) * t[at]
                size = np.linalg.norm(side, axis=1, keepdims=True)
                held[:m] = normals[at] = np.where(size > 1e-9, side / np.maximum(size, 1e-300), held[:m])
            last = normals[-1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "n", "x", "y", "z")), *(pa.array(v) for v in normals.T)], ["path", "n", "x", "y", "z", "nx", "ny", "nz"])

    d = d.select(F.col("path").cast("long").alias("path"), F.col("n").cast("int").alias("n"), *[c for c in d.columns if c not in ("path", "n")])
    return d.mapInArrow(run, "path long, n int, x double, y double, z double, nx double, ny double, nz double")
