"""Writes that fail leave what was there; numbers go on under two writers; the envelope of a search."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from heddle.operators import results as E
from heddle.sources import files
from heddle.sources.sinks import Versions


def bad(spark, n=5):
    return spark.range(n).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("x"))


def test_json_is_swapped_whole(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    files.save_json(spark.range(5), path)
    with pytest.raises(Exception, match="no"):
        files.save_json(bad(spark), path)
    assert sorted(r.id for r in spark.read.json(path).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(FileExistsError):
        files.save_json(spark.range(2), path, replace=False)
    files.save_json(spark.range(2), path)
    assert spark.read.json(path).count() == 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out"]


def test_versions_survive_failures_and_two_writers(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/table")
    with pytest.raises(ValueError):
        v.read()
    assert v.write(spark.range(3)) == 1
    with pytest.raises(Exception, match="no"):
        v.write(bad(spark))
    assert v.versions() == [1] and v.read().count() == 3
    assert v.write(spark.range(7)) == 3  # a failed write's number isn't given again
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: Versions(spark, v.path).claim(), range(24)))
    assert len(set(numbers)) == 24 and min(numbers) == 4
    late = v.write(spark.range(1))
    assert v.read().count() == 1 and v.read(3).count() == 7
    v.forget(1)
    assert v.versions() == [late] and v.read().count() == 1
    with pytest.raises(ValueError):
        v.read(3)
    assert v.claim() == late + 1




def test_a_paged_service_is_read_once(spark, tmp_path):

    seen = str(tmp_path / "count")
    (tmp_path / "pages_once.py").write_text(f"def pages(token):\n    open({seen!r}, 'a').write('x')\n    return {{'rows': [{{'n': 1}}], 'next': 'more'}}\n")
    spark.sparkContext.addPyFile(str(tmp_path / "pages_once.py"))
    rows, more = files.paged(spark, "pages_once:pages", 3)
    assert rows.count() == 3 and more.first().truncated is True and rows.count() == 3
    assert len(open(seen).read()) == 3


def test_envelope_of_results(spark):
    rows = spark.createDataFrame([(i, float(i % 4)) for i in range(9)], "id int, score double")
    order = [F.col("score").desc(), F.col("id").asc()]
    d = E.envelope(rows, order, E.echo("lung cancer", near=(1.5, -2.0)), 3, True).first()
    assert [r.id for r in d.results] == [3, 7, 2] and d.result_count_before_limit == 9
    assert d.search_truncated and d.truncation_note and d.hint is None and d.warning
    said = json.loads(d.search)
    assert said["near"] == [1.5, -2.0] and said["radius_miles"] == 50.0 and said["open_site_statuses"][0] == "RECRUITING"
    none = E.envelope(rows.where("id > 99"), order, E.echo("x"), 3).first()
    assert none.results == [] and none.hint and none.truncation_note is None and json.loads(none.search)["radius_miles"] is None
    assert E.envelope(rows, order, E.echo("x"), 0).first().results == []
    texts = spark.createDataFrame([("a" * 1999 + "   b",), ("short",), (None,)], "t string").select(E.criteria(F.col("t")).alias("t"), E.criteria(F.col("t"), True).alias("full")).collect()
    assert texts[0].t == "a" * 1999 + E.NOTICE and texts[0].full.endswith("b") and texts[1].t == "short" and texts[2].t == ""
