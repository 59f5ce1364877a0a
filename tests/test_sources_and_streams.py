import json
import struct
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.sources import files
from heddle.streaming import live


def test_json_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nbroken {\n{"x": 2}\n')
    assert sorted(r.x for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    (tmp_path / "b.json").write_bytes('﻿{\r\n"x": 3}\r\n'.encode())
    assert files.json_document(spark, str(tmp_path / "b.json"), T.StructType().add("x", "integer")).select("doc.x").first().x == 3


def test_folder_scan_and_newest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n, name in enumerate(("d/1.dcm", "d/2.PDF", "3", "d/4.dcm")):
        (tmp_path / name).write_bytes(b"x" * (n + 1))
        time.sleep(0.02)
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.folder(spark, str(tmp_path)).collect()) == ["1.dcm", "3", "4.dcm"]
    assert files.newest(spark, str(tmp_path / "d"), "*.dcm").first().path.endswith("4.dcm")


def test_scenes(spark, tmp_path):
    body = json.dumps({"nodes": [1]}).encode()
    raw = struct.pack("<4sII", b"glTF", 2, 20 + len(body)) + struct.pack("<I4s", len(body), b"JSON") + body
    (tmp_path / "a.glb").write_bytes(raw)
    (tmp_path / "b.glb").write_bytes(raw[:10])
    (tmp_path / "c.glb").write_bytes(raw.replace(b"glTF\x02", b"glTF\x01"))
    got = {r.path.rsplit("/", 1)[1]: r.json for r in files.scenes(spark, str(tmp_path)).collect()}
    assert got == {"a.glb": body.decode(), "b.glb": None, "c.glb": None}


def test_retries():
    calls, waits = [], []

    def get():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return {"ok": 1}

    assert files.retried(get, wait=waits.append) == {"ok": 1} and waits == [1, 2]
    with pytest.raises(OSError):
        files.retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, wait=waits.append)


def pages(token):
    n = int(token or 0)
    return {"rows": [{"n": 10 * n + i} for i in range(3)], "next": str(n + 1)}


def last_page(token):
    return {"rows": [{"n": 1}]}


def test_paged_source(spark):
    spark.dataSource.register(files.Pages)
    d = spark.read.format("heddle_pages").option("pages", f"{__name__}:pages").option("most", 2).load()
    assert [(r.position, json.loads(r.row)["n"]) for r in d.where("not truncated").orderBy("position").collect()] == [(0, 0), (1, 1), (2, 2), (3, 10), (4, 11), (5, 12)]
    rows, more = files.paged(spark, f"{__name__}:pages", 2)
    assert rows.count() == 6 and more.first().truncated is True
    rows, more = files.paged(spark, f"{__name__}:last_page", 2)
    assert rows.count() == 1 and more.first().truncated is False


def test_numbering_goes_on(spark):
    old = spark.createDataFrame([("cap-0007.png",), ("other-9.png",)], "name string")
    new = spark.createDataFrame([(2,), (1,)], "id int")
    assert [r.name for r in files.numbered_names(old, new, ["id"], "cap").orderBy("id").collect()] == ["cap-0008", "cap-0009"]


def change(spark, path, rows):
    spark.createDataFrame(rows, "k int, v int, version int, gone boolean").coalesce(1).write.mode("append").parquet(path)


def test_stream_upserts_deletes_and_resumes(spark, tmp_path):
    source, log, mark = (str(tmp_path / n) for n in ("in", "log", "mark"))
    schema = T.StructType().add("k", "integer").add("v", "integer").add("version", "integer").add("gone", "boolean")
    write = live.upsert_to(log, ["k"], ["version"], "gone")

    def run():
        q = live.ingest(live.read(spark, source, schema), write, mark)
        q.awaitTermination(60)
        return sorted((r.k, r.v) for r in live.current(spark, log, ["k"], ["version"], "gone").collect())

    change(spark, source, [(1, 10, 1, False), (2, 20, 1, False), (1, 11, 2, False)])
    assert run() == [(1, 11), (2, 20)]
    change(spark, source, [(2, 0, 2, True), (3, 30, 1, False), (1, 5, 1, False)])
    assert run() == [(1, 11), (3, 30)]
    assert run() == [(1, 11), (3, 30)]


def test_snapshots_replace_each_other(spark, tmp_path):
    write = live.snapshot_to(str(tmp_path / "snap"))
    for n, rows in enumerate(([(1,), (2,)], [(3,)])):
        write(spark.createDataFrame(rows, "x int"), n)
    assert [r.x for r in live.last_snapshot(spark, str(tmp_path / "snap")).collect()] == [3]


def test_stream_content_dedup(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "b")], "ts string, c string").select(F.col("ts").cast("timestamp").alias("ts"), "c").coalesce(1).write.parquet(source)
    schema = T.StructType().add("ts", "timestamp").add("c", "string")
    out = live.content_dedup(live.read(spark, source, schema), "c", "ts")
    q = out.writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.c for r in spark.sql("select c from dedup").collect()) == ["a", "b"]


def test_masks_are_kept_by_structure(spark, tmp_path):
    rows = [("lung", 0, 0, k) for k in range(40)] + [("7", 1, 2, 3)]
    files.save_masks(spark.createDataFrame(rows, "structure string, k int, j int, i int"), f"{tmp_path}/m")
    assert sorted(files.masks(spark, f"{tmp_path}/m").select("structure", "k", "j", "i").collect()) == sorted(rows)
    one = files.masks(spark, f"{tmp_path}/m", ["7"])
    assert [tuple(r) for r in one.select("structure", "k", "j", "i").collect()] == [("7", 1, 2, 3)]
    assert len({r[0].split("/")[-2] for r in one.select("_metadata.file_path").collect()}) == 1
