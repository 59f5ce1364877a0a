import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.sources import sinks
from heddle.streaming import collection, live

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("k", T.StringType()), ("n", T.IntegerType()), ("text", T.StringType()), ("op", T.StringType()), ("ts", T.TimestampType()), ("seq", T.LongType()), ("if_version", T.LongType()))])


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(collection.STORE[0])
    spark.conf.set(*collection.STORE)
    yield spark
    spark.conf.set(collection.STORE[0], old)


def file(spark, path, *rows):
    d = spark.createDataFrame([(k, n, t, op, f"2024-01-01 {at}", seq, v) for k, n, t, op, at, seq, v in rows], "k string, n int, text string, op string, ts string, seq long, if_version long")
    d.withColumn("ts", F.to_timestamp("ts")).select(*SCHEMA.names).coalesce(1).write.mode("append").parquet(path)


def test_versions_conditions_and_restarts(rocks, tmp_path):
    spark, (source, out, mark) = rocks, (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        seen = {f for _, _, names in os.walk(out) for f in names}
        d = collection.documents(live.read(spark, source, SCHEMA), ["k"], ["n", "text"], "10 minutes", 20 * 60 * 1000)
        q = d.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination(100)
        assert q.exception() is None
        state = max((s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]), default=0)
        rows = spark.read.schema("k string, seq long, outcome string, version long, deleted boolean, n int, text string").parquet(out)
        new = rows.where(~F.element_at(F.split("_metadata.file_path", "/"), -1).isin(*seen, "")).collect()
        return {(r.k, r.seq): (r.outcome, r.version, r.deleted, r.n, r.text) for r in new}, state

    file(spark, source, ("a", 1, "x", "set", "10:00:00", 1, None), ("a", None, "y", "update", "10:00:01", 2, 1), ("a", 9, "z", "set", "10:00:02", 3, 1), ("b", 1, None, "update", "10:00:00", 4, None), ("c", 5, "c", "set", "10:00:00", 5, 0), ("c", None, None, "bend", "10:00:00", 6, None))
    got, _ = run()
    assert got == {("a", 1): ("applied", 1, False, 1, "x"), ("a", 2): ("applied", 2, False, 1, "y"), ("a", 3): ("stale", 2, False, 1, "y"), ("b", 4): ("missing", 0, True, None, None), ("c", 5): ("applied", 1, False, 5, "c"), ("c", 6): ("unknown", 1, False, 5, "c")}
    # another run goes on with what is stored; an earlier change comes after a later one
    file(spark, source, ("a", 0, "old", "set", "09:59:00", 7, None), ("c", None, None, "delete", "10:01:00", 8, 1), ("c", 6, "again", "set", "10:00:30", 9, None), ("a", 3, "w", "set", "10:02:00", 10, 2))
    got, state = run()
    # the set of 10:00:30 made version 2, so the deletion of version 1 is stale
    assert got == {("a", 7): ("late", 2, False, 1, "y"), ("c", 9): ("applied", 2, False, 6, "again"), ("c", 8): ("stale", 2, False, 6, "again"), ("a", 10): ("applied", 3, False, 3, "w")}
    assert state == 2
    file(spark, source, ("c", None, None, "delete", "10:03:00", 11, 2), ("c", 7, None, "update", "10:03:01", 12, None), ("c", 8, "new", "set", "10:03:02", 13, 0))
    assert run()[0] == {("c", 11): ("applied", 3, True, None, None), ("c", 12): ("missing", 3, True, None, None), ("c", 13): ("applied", 4, False, 8, "new")}
    assert run()[0] == {}


def test_deletions_are_forgotten_in_time(rocks, tmp_path):
    spark, (source, mark) = rocks, (str(tmp_path / n) for n in ("in", "mark"))
    kept = []

    def run():
        d = collection.documents(live.read(spark, source, SCHEMA, per_batch=1), ["k"], ["n", "text"], "10 minutes", 20 * 60 * 1000)
        q = d.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.format("noop").mode("overwrite").save()).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination(100)
        kept.append(sum(s["numRowsTotal"] for p in q.recentProgress[-1:] for s in p["stateOperators"] if s["operatorName"].startswith("transformWithState")))

    file(spark, source, *[(f"k{i}", i, "t", "set", "10:00:00", i, None) for i in range(30)])
    run()
    file(spark, source, *[(f"k{i}", None, None, "delete", "10:00:10", 100 + i, None) for i in range(25)])
    run()
    for at in ("11:00:00", "11:30:00", "12:00:00"):  # time goes on: the watermark passes the timers
        file(spark, source, ("z", 1, "t", "set", at, 1000, None))
        run()
    assert kept == [30, 30, 6, 6, 6]  # 25 deletions are remembered, then forgotten: five that live, and z


def test_names_and_times_are_checked(spark):
    d = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="remembered"):
        collection.documents(d, ["k"], ["n"], "1 hour", 1000)
    with pytest.raises(ValueError, match="meaning"):
        collection.documents(d, ["k"], ["op"])


def test_the_log_of_changes_is_folded(spark, tmp_path):
    path = str(tmp_path / "log")
    write = live.upsert_to(path, ["k"], ["version"], "gone", every=3)
    want = {}
    for n in range(14):
        rows = [(k, 100 * n + k, n + 1, (k + n) % 5 == 0) for k in range(n % 4, 12, 2)]
        want |= {k: None if gone else v for k, v, _, gone in rows}
        write(spark.createDataFrame(rows, "k int, v int, version int, gone boolean").coalesce(1), n)
        assert {r.k: r.v for r in live.current(spark, path, ["k"], ["version"], "gone").collect()} == {k: v for k, v in want.items() if v is not None}
        assert len(sinks.numbers(spark, f"{path}/changes", "batch=")) <= 6 and len(sinks.Versions(spark, f"{path}/base").versions()) <= 2
    write(spark.createDataFrame([(3, -1, 1, False), (0, -1, 0, False)], "k int, v int, version int, gone boolean"), 14)  # older than what is there
    assert {r.k: r.v for r in live.current(spark, path, ["k"], ["version"], "gone").collect()} == {k: v for k, v in want.items() if v is not None}
