"""Volumes from slices, crops, a viewer's settings, report blocks and shift accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import viewer as O
from heddle.session import Catalog, table

CATALOG = Catalog()


@CATALOG.add(
    "volume_load",
    """WITH s AS (SELECT l_orderkey, (l_linenumber + l_linenumber % 3) // 2 * 1.5::DOUBLE AS pos, first(floor(l_extendedprice) - 40000 ORDER BY l_linenumber, l_extendedprice) AS v FROM lineitem GROUP BY ALL),
         e AS (SELECT l_orderkey, min(pos) AS first, max(pos) AS last FROM s GROUP BY ALL),
         t AS (SELECT l_orderkey, k, first + k * 0.75 AS at FROM (SELECT *, unnest(range(CAST(floor((last - first) / 0.75 + 1e-6) AS BIGINT) + 1)) AS k FROM e)),
         n AS (SELECT *, lead(pos) OVER (PARTITION BY l_orderkey ORDER BY pos) AS pos2, lead(v) OVER (PARTITION BY l_orderkey ORDER BY pos) AS v2 FROM s),
         r AS (SELECT t.l_orderkey, t.k, round_even(CASE WHEN n.pos2 IS NULL OR t.at = n.pos THEN n.v ELSE (1 - (t.at - n.pos) / (n.pos2 - n.pos)) * n.v + (t.at - n.pos) / (n.pos2 - n.pos) * n.v2 END, 0) AS v FROM t ASOF JOIN n ON t.l_orderkey = n.l_orderkey AND t.at >= n.pos)
       SELECT l_orderkey, k, CAST(greatest(-32768, least(32767, v)) AS INTEGER) AS value, v < -32768 OR v > 32767 AS clipped FROM r""",
)
def volume_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", n, (F.floor((n + n % 3) / 2) * 1.5).alias("pos"), (F.floor("l_extendedprice") - 40000).cast("double").alias("v"))
    return O.load_volume(s, "l_orderkey", "l_linenumber", "pos", "v", 0.75)


@CATALOG.add(
    "crop_resolve",
    """SELECT p_partkey, b AS k0, b + n AS k1, CASE WHEN n <= 0 THEN 'empty crop' END AS error FROM (SELECT *, CAST(floor((e - b) / (1.0::DOUBLE + p_partkey % 4)) * (1 + p_partkey % 4) AS BIGINT) AS n FROM (
         SELECT p_partkey, greatest(0, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 40 - 10 WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END) AS b,
           least(p_size, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 60 WHEN p_partkey % 2 = 0 THEN p_size - 3 ELSE p_size END) AS e FROM part))""",
)
def crop_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    begin, end, error = O.crop(F.when(k % 3 == 0, k % 40 - 10), F.when(k % 5 == 0, k % 60), k % 2 == 0, F.lit(5), size - 3, size, 1 + k % 4)
    return table(spark, sf_dir, "part").select(k, begin.alias("k0"), end.alias("k1"), error.alias("error"))


MODES_SQL = """SELECT p_partkey AS place, 'm' || p_partkey % 500 AS mode_id, CASE WHEN p_partkey % 11 > 0 THEN p_name END AS label, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 30 END AS view,
    CASE p_partkey % 5 WHEN 1 THEN 'normal' WHEN 2 THEN 'etapas' WHEN 3 THEN 'reseccion' WHEN 4 THEN CASE WHEN p_partkey % 7 = 0 THEN 'other' END END AS module, CASE WHEN p_partkey % 4 > 0 THEN 1 END AS lumen, CASE WHEN p_partkey % 6 > 0 THEN 1 END AS wall,
    CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 8 END AS sequence, p_partkey % 9 AS option, CASE p_partkey % 7 WHEN 1 THEN 'saca' WHEN 2 THEN 'queda' WHEN 3 THEN 'both' END AS phase FROM part"""


@CATALOG.add(
    "mode_checks",
    f"""WITH m AS ({MODES_SQL})
        SELECT mode_id, place, 'repeated id' AS rule FROM m WHERE EXISTS (SELECT 1 FROM m o WHERE o.mode_id = m.mode_id AND o.place < m.place)
        UNION ALL SELECT mode_id, place, 'no label' FROM m WHERE label IS NULL
        UNION ALL SELECT mode_id, place, 'unknown view' FROM m WHERE view IS NOT NULL AND view NOT IN (SELECT n_nationkey FROM nation)
        UNION ALL SELECT mode_id, place, 'unknown module' FROM m WHERE module = 'other'
        UNION ALL SELECT mode_id, place, 'lumen and wall needed' FROM m WHERE module = 'normal' AND (lumen IS NULL OR wall IS NULL)
        UNION ALL SELECT mode_id, place, 'unknown sequence' FROM m WHERE module = 'etapas' AND (sequence IS NULL OR sequence > 4)
        UNION ALL SELECT mode_id, place, 'unknown option' FROM m WHERE module = 'reseccion' AND option > 4
        UNION ALL SELECT mode_id, place, 'unknown phase' FROM m WHERE module = 'reseccion' AND phase = 'both'""",
)
def mode_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    module = F.when(k % 5 == 1, "normal").when(k % 5 == 2, "etapas").when(k % 5 == 3, "reseccion").when((k % 5 == 4) & (k % 7 == 0), "other")
    modes = table(spark, sf_dir, "part").select(
        k.alias("place"), F.concat(F.lit("m"), (k % 500).cast("string")).alias("mode_id"), F.when(k % 11 > 0, F.col("p_name")).alias("label"), F.when(k % 3 > 0, k % 30).alias("view"),
        module.alias("module"), F.when(k % 4 > 0, 1).alias("lumen"), F.when(k % 6 > 0, 1).alias("wall"), F.when(k % 4 > 0, k % 8).alias("sequence"), (k % 9).alias("option"),
        F.when(k % 7 == 1, "saca").when(k % 7 == 2, "queda").when(k % 7 == 3, "both").alias("phase"),
    )
    views = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))
    return O.mode_violations(modes, views, regions, regions)


@CATALOG.add(
    "step_checks",
    """WITH s AS (SELECT o_orderkey, o_orderkey % 13 > 0 AS caption, o_orderkey % 5 = 0 AS alone, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 / 1000.0::DOUBLE END AS factor, o_orderkey % 3 = 0 AS scaled,
           CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 6 + 1 END AS lumen, CASE WHEN o_orderkey % 4 > 1 THEN o_orderkey % 7 + 1 END AS wall, CASE WHEN o_orderkey % 11 > 0 THEN 2 END AS a, 2 + o_orderkey % 6 AS b FROM orders)
       SELECT o_orderkey, 'no caption' AS rule FROM s WHERE NOT caption
       UNION ALL SELECT o_orderkey, 'factor too small' FROM s WHERE alone AND (factor IS NULL OR factor < 0.01)
       UNION ALL SELECT o_orderkey, 'lumen and wall go together' FROM s WHERE NOT alone AND (lumen IS NULL) <> (wall IS NULL)
       UNION ALL SELECT o_orderkey, 'no span' FROM s WHERE NOT alone AND lumen IS NOT NULL AND a IS NULL
       UNION ALL SELECT o_orderkey, 'lumen isn''t as long as the span' FROM s WHERE NOT alone AND lumen <> b - a + 1
       UNION ALL SELECT o_orderkey, 'wall isn''t as long as the span' FROM s WHERE NOT alone AND lumen IS NOT NULL AND wall <> b - a + 1
       UNION ALL SELECT o_orderkey, 'nothing to do' FROM s WHERE NOT alone AND lumen IS NULL AND NOT scaled""",
)
def step_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    values = lambda n: F.array_repeat(F.lit(1.0), n.cast("int"))
    steps = table(spark, sf_dir, "orders").select(
        k, F.when(k % 13 > 0, "x").alias("caption"), F.when(k % 5 == 0, "escala").alias("kind"), F.when(k % 2 == 0, k % 100 / 1000.0).alias("factor"), (k % 3 == 0).alias("scaled"),
        F.when(k % 4 > 0, values(k % 6 + 1)).alias("lumen"), F.when(k % 4 > 1, values(k % 7 + 1)).alias("wall"), F.when(k % 11 > 0, 2).alias("first"), (2 + k % 6).alias("last"),
    )
    return O.step_violations(steps, ["o_orderkey"])


@CATALOG.add(
    "report_blocks",
    """SELECT l_orderkey, CAST(d - 1 AS INTEGER) AS block, CAST(0 AS INTEGER) AS line, 0 AS depth, 'heading' AS kind, f AS text FROM (SELECT l_orderkey, f, row_number() OVER (PARTITION BY l_orderkey ORDER BY f) AS d FROM (SELECT DISTINCT l_orderkey, l_returnflag AS f FROM lineitem))
       UNION ALL SELECT l_orderkey, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS INTEGER), CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS INTEGER), 1, 'item', CAST(l_linenumber AS VARCHAR) FROM lineitem""",
)
def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report (here an order) of blocks (a return flag each) with items, written out line by line."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.lit("item").alias("kind"), F.col("l_linenumber").cast("string").alias("text"))
    block = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(item)).alias("children"))
    block = F.struct(F.col("l_returnflag").alias("text"), F.lit("heading").alias("kind"), "children"), block
    reports = block[1].groupBy("l_orderkey").agg(F.array_sort(F.collect_list(block[0])).alias("blocks"))
    return O.block_lines(reports, "l_orderkey", "blocks").select("l_orderkey", F.col("place")[0].alias("block"), F.col("place")[1].alias("line"), "depth", "kind", "text")


ACCOUNT_SQL = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'He ate lunch. No urine since noon! ' WHEN 1 THEN 'Pulse 80, a low fever. ' WHEN 2 THEN 'Slept well. ' ELSE '' END AS said FROM conversations"""


@CATALOG.add(
    "shift_signs",
    f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'no urine' WHEN 1 THEN 'fever' ELSE '' END AS signs, turn % 4 < 2 AS first, CASE turn % 4 WHEN 1 THEN 'pulse 80, a low fever.' END AS vital_signs, CASE turn % 4 WHEN 0 THEN 'he ate lunch.' END AS feeding,
        CASE turn % 4 WHEN 0 THEN 'no urine since noon!' END AS fluids_and_output, CASE turn % 4 WHEN 2 THEN 'slept well.' END AS condition FROM ({ACCOUNT_SQL})""",
)
def shift_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn")
    said = F.when(k % 4 == 0, "He ate lunch. No urine since noon! ").when(k % 4 == 1, "Pulse 80, a low fever. ").when(k % 4 == 2, "Slept well. ").otherwise("")
    d = O.shift_record(table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said")), ["conv_id", "turn"], "said")
    return d.select("conv_id", "turn", F.array_join("signs", ", ").alias("signs"), "first", "vital_signs", "feeding", "fluids_and_output", "condition")
