"""File names of a batch are numbered without bringing its rows into one task."""

from heddle.sources import files


def test_names_are_numbered_in_order_by_many_tasks(spark):
    old = spark.createDataFrame([("cap-0007.png",), ("other-0099.png",)], "name string")
    rows = [(None if i == 40 else i, f"r{i}") for i in range(400)]
    new = files.numbered_names(old, spark.createDataFrame(rows[::-1], "id int, what string").repartition(5), ["id"], "cap")
    got = {r.what: r.name for r in new.collect()}
    order = [rows[40], *(r for r in rows if r[0] is not None)]
    assert got == {what: f"cap-{8 + n:04d}" for n, (_, what) in enumerate(order)}
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0] and "__pid" in plan
