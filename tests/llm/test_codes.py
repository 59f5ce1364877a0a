"""Codebooks of integer vectors against plain Python integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from heddle.llm import codes
from heddle.llm.work import Work

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v, _ in kept)
    span = max(1, -(-width // parts))
    kept = [(i, v + [0] * (span * parts - len(v)), lab) for i, v, lab in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [v[p * span : (p + 1) * span] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, own: min((far(own, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        got = [[best(p, cut(v)[p])[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), g in zip(kept, got) if g[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for part in books for c in part for x in c).encode()).hexdigest()
    out, labels = [], {}
    for i, v, lab in kept:
        found = [best(p, cut(v)[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        labels[lab] = labels.get(lab, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, lab))
    return sorted(((i, c, min(e, codes.LONGEST), min(labels[lab], codes.LONGEST), sha) for i, c, e, lab in out), key=repr)


def coded(spark, rows, schema=VECTORS, **kw):
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = codes.compress(df, Work(spark, "test"), **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def vectors(n, width, seed=1, scale=0.2):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0, scale, width)], int(rng.integers(0, 4))) for i in range(n)]


def test_codes_match_brute_force_with_nulls_ties_and_repeats(spark):
    rows = vectors(150, 16)
    rows[3] = (3, None, 1)
    rows[4] = (4, [None, *rows[4][1][1:]], 1)
    rows[5] = (5, [math.nan, *rows[5][1][1:]], 1)
    rows[6] = (6, [math.inf, *rows[6][1][1:]], None)
    rows[7] = (7, rows[7][1], None)
    rows[8] = (None, rows[8][1], None)
    rows += [rows[20]] * 30 + [(500 + i, [0.0] * 16, 2) for i in range(20)]  # equal rows, and ties between equal entries
    rows += [(2, rows[0][1], 3), (2, rows[1][1], 3)]
    assert coded(spark, rows) == brute(rows)


@pytest.mark.parametrize("width,n", [(1, 40), (13, 40), (8, 5), (24, 1)])
def test_codes_of_odd_widths_and_few_vectors(spark, width, n):
    rows = vectors(n, width, seed=width)
    if n > 5:
        rows[2] = (2, rows[2][1][: width // 2], 0)
    assert coded(spark, rows) == brute(rows)


def test_codes_of_large_components_are_exact(spark):
    rows = [(i, [x * 10.0 ** (i % 9) for x in v], lab) for i, v, lab in vectors(60, 8, seed=4)]
    assert coded(spark, rows) == brute(rows)
    rows.append((70, [1e30, *[0.0] * 7], 1))  # a lone entry's distance is 0; others may be beyond a long
    assert coded(spark, rows, entries=3) == brute(rows, entries=3)


def test_no_usable_vector_gives_no_row_and_clashing_columns_are_not_read(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1), (2, [math.nan], 2)]) == []
    assert coded(spark, [(1, [], 1)]) == brute([(1, [], 1)])
    rows = vectors(30, 8)
    wide = [(*r, "x", 5, "y", 7) for r in rows]
    assert coded(spark, wide, VECTORS + ", code string, error int, vec string, id int") == brute(rows)
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame(rows, VECTORS), Work(spark, "test"), entries=300)


def test_screening_spares_most_exact_distances_and_never_the_best():
    rng = np.random.default_rng(5)
    x = rng.integers(-2000, 2000, (3000, 64))
    books = codes.Codebooks([[[int(v) for v in e] for e in rng.integers(-2000, 2000, (16, 8))] for _ in range(8)])
    index, error, looked = books.nearest(x)
    assert looked < 1.1 * x.shape[0] * 8  # of 16 distances a part, little over one
    for p in range(8):
        d = ((x[:, None, p * 8 : p * 8 + 8] - np.array(books.entries[p])[None]) ** 2).sum(axis=2)
        assert (d.argmin(axis=1) == index[:, p]).all() and (d.min(axis=1) == error[:, p]).all()
    same = codes.Codebooks([[[int(v) for v in x[0, :8]]] * 16 for _ in range(8)])
    assert (same.nearest(x)[0] == 0).all()
    near = codes.Codebooks([[[2**21 + i % 3] * 8 for i in range(16)] for _ in range(8)])  # float32 can't tell these apart
    y = np.full((50, 64), 2**21 + 1)
    assert (near.nearest(y)[0] == 1).all() and not near.nearest(y)[1].any()


def test_query_equals_its_sql_and_brute_force(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = codes.op11_codes(spark, sf)
    assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(con.sql(codes.OP11_SQL).select("vec_id,code,error,label_error,codebooks_sha256").fetchall(), key=repr) == brute(rows)
