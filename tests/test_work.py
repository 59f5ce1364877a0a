"""Distributed ranks keep columns of any name, and deal equal rows out."""

from heddle.work import Work, ranked

NAMES = ["place", "range", "row", "n", "before", "p", "by0", "__pid", "__rn", "__n", "__p", "Rank_"]


def test_ranks_keep_columns_of_any_name(spark):
    rows = [(i % 7 if i % 5 else None, f"s{i % 3}", *(100 * i + k for k in range(len(NAMES)))) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, s string, " + ", ".join(f"`{c}` long" for c in NAMES)).repartition(5)
    out = ranked(Work(spark, "test"), d, ["s"], ["id"], "rank")
    assert out.columns == [*d.columns, "rank"]
    got = out.collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted(rows, key=repr)
    for s in ("s0", "s1", "s2"):
        own = sorted((r for r in got if r.s == s), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        ids = [r.id for r in own]
        assert ids == sorted(ids, key=lambda i: (i is None, i or 0))


def test_equal_rows_fall_in_several_ranges(spark):
    work = Work(spark, "test")
    d = spark.range(4000).selectExpr("1 AS id", "'t' AS text").repartition(4)
    saved = []
    keep, work.save = work.save, lambda df, name="t": saved.append(keep(df, name)) or saved[-1]
    assert sorted(r.rank for r in ranked(work, d, [], ["id", "text"], "rank").collect()) == list(range(1, 4001))
    sizes = [r["count"] for r in saved[0].groupBy("range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000
