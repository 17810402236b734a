"""Gates of scenarios at the edge: each passes whole runs and fails a broken row or a missing one."""

import pytest
from pyspark.sql import functions as F

from pitgauge.operators import scenario as SC

NAMES = ["scale0", "start0", "overrun", "surge", "short_template"]
COLUMNS = ["scenario_id", "zone_id", "day_idx", "start_day", "blastable", "fos", "base_fos", "ppv", "base_ppv", "rainfall_mm", "base_rain"]
TYPES = ["string", "string", "int", "int", "boolean", "double", "double", "double", "double", "double", "double"]


def rows():
    return [dict(zip(COLUMNS, (n, z, d, 1, z == "A", 1.5, 1.5, 9.0 if n == "surge" and z == "A" else 2.0, 2.0, 7.0 if n == "short_template" and 1 <= d <= 2 else 3.0, 3.0)))
            for n in NAMES for z in ("A", "B") for d in range(5)]


def failed(spark, made):
    panel = spark.createDataFrame([(z, d) for z in ("A", "B") for d in range(5)], "zone_id string, day_idx int")
    runs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in made], ", ".join(f"{c} {t}" for c, t in zip(COLUMNS, TYPES)))
    got = SC.edge_gates(panel, runs, template_days=2).collect()
    assert {r.gate: r.checked_rows for r in got} == {**{n: 10 for n in NAMES}, "unknown_kind": 1}
    return {r.gate: r.failed_rows for r in got if r.failed_rows}


def test_whole_runs_pass(spark):
    assert failed(spark, rows()) == {}


@pytest.mark.parametrize("gate, zone, day, change", [
    ("scale0", "A", 3, {"fos": 1.4}), ("start0", "B", 0, {"fos": float("nan")}), ("overrun", "A", 4, {"fos": None}),
    ("surge", "B", 2, {"ppv": 9.0}), ("short_template", "A", 3, {"rainfall_mm": 7.0})])
def test_a_broken_row_fails_its_gate(spark, gate, zone, day, change):
    made = [r | change if (r["scenario_id"], r["zone_id"], r["day_idx"]) == (gate, zone, day) else r for r in rows()]
    assert failed(spark, made) == {gate: 1}


def test_missing_rows_and_missing_runs_fail(spark):
    made = [r for r in rows() if r["scenario_id"] != "start0" and not (r["scenario_id"] == "overrun" and r["day_idx"] == 4)]
    assert failed(spark, made) == {"overrun": 2, "start0": 10}


def test_rows_of_a_scenario_task_are_bounded(spark, monkeypatch):
    """The number of tasks follows the rows of the panel and the scenarios and is not reduced by compressed sizes; series stay whole."""
    monkeypatch.setattr(SC, "TASK_ROWS", 50)
    df = spark.range(1000).selectExpr("id % 40 as seed", "id as day_idx")
    dealt = SC._dealt(df, 1000, ["seed"])
    assert dealt.rdd.getNumPartitions() == 20
    assert dealt.withColumn("at", F.spark_partition_id()).groupBy("seed").agg(F.countDistinct("at").alias("n")).where("n > 1").isEmpty()
    assert SC._dealt(df.limit(0), 0, ["seed"]).count() == 0
