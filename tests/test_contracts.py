"""Contract rules over groups: each broken once, and gates with a broken chain."""

import pytest
from pyspark.sql import functions as F

from pitgauge.operators import contracts as CT
from pitgauge.operators import quality as Q
from pitgauge.operators import scenario as SC
from pitgauge.operators import setops as SO


def passed(df, rules):
    return {r["rule_id"]: r["passed"] for r in Q.check_groups(df, rules).collect()}


def test_season_order(spark):
    df = spark.createDataFrame([(11, 9.0), (11, 3.0), (2, 5.0), (7, 99.0)], "month int, rainfall_mm double")
    assert passed(df, CT.season_rules()) == {"nov_above_feb": True}
    assert passed(df.withColumn("month", 13 - F.col("month")), CT.season_rules()) == {"nov_above_feb": False}
    assert passed(df.where("month <> 2"), CT.season_rules()) == {"nov_above_feb": False}


def test_thrust_and_confined_zone(spark):
    good = [("ZONE_A", 40.0, 20.0, 60.0), ("ZONE_D", 600.0, 490.0, 785.0)]
    schema = "zone_code string, thrust double, thrust_lo double, thrust_hi double"
    ok = spark.createDataFrame(good, schema)
    assert passed(ok, CT.confined_rules()) == {"confined_zone_highest": True}
    low = spark.createDataFrame([good[0], ("ZONE_D", 300.0, 490.0, 785.0)], schema)
    assert passed(low, CT.confined_rules()) == {"confined_zone_highest": False}
    assert [r["failed_rows"] for d in (ok, low) for r in Q.check_rows(d, CT.thrust_rules()).collect()] == [0, 1]


def test_blast_rates(spark):
    def rates(a, b, low=0.5):
        """Series-days in which a share of the days fires: a rate of 7 a week is every day."""
        rows = [(z, i, i % 100 < r * 100 / 7, 6.0 if i % 10 < low * 10 else 20.0) for z, r in (("ZONE_A", a), ("ZONE_B", b), ("ZONE_C", 0)) for i in range(1_000)]
        return spark.createDataFrame(rows, "zone_code string, day_idx int, blast_occurs boolean, frequency_hz double")

    good = passed(rates(7, 7), CT.blast_rate_rules())
    assert all(good.values()) and set(good) == {"rate_conserved", "rate_shared", "rate_in_band_ZONE_A", "rate_in_band_ZONE_B", "many_events_ZONE_A", "many_events_ZONE_B", "low_frequency_share"}
    few = passed(rates(7, 0), CT.blast_rate_rules())
    assert [r for r, ok in few.items() if not ok] == ["rate_conserved", "rate_shared", "rate_in_band_ZONE_B", "many_events_ZONE_B"]
    assert [r for r, ok in passed(rates(7, 7, 0.9), CT.blast_rate_rules()).items() if not ok] == ["low_frequency_share"]
    odd = rates(7, 7).withColumn("frequency_hz", F.when(F.col("day_idx") == 3, 40.0).otherwise(F.col("frequency_hz")))
    assert Q.check_rows(odd, CT.frequency_rules()).first()["failed_rows"] == 2


def test_score_line(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("fos"), (100.0 - F.col("id")).alias("instability_score"))
    assert passed(df, CT.score_rules()) == {"score_anti_correlated": True}
    bent = df.withColumn("instability_score", F.when(F.col("fos") < 10, 0.0).otherwise(F.col("instability_score")))
    assert passed(bent, CT.score_rules()) == {"score_anti_correlated": False}


def test_spells(spark):
    rows = [(s, "floor" if z else "bench", r, p, q) for s in (1, 2) for z in (0, 1) for r, p, q in ((40.0, 9.0, 60.0), (50.0, 8.0, 50.0), (1.0, 2.0 if s == 1 else 20.0, 10.0), (2.0, 3.0 if s == 1 else 30.0, 20.0), (15.0, 99.0, 99.0))]
    df = spark.createDataFrame([*rows, (3, "bench", 40.0, 1.0, 1.0)], "seed int, kind string, rainfall_7d_mm double, pore_kpa double, instability_score double")
    got = {(r["seed"], r["rule_id"]): (r["passed"], r["detail"]) for r in CT.spell_rules(df, ["seed"]).collect()}
    assert got == {(1, "wet_raises_pore"): (True, 6.0), (1, "wet_raises_score"): (True, 40.0), (1, "floor_tail_rises"): (True, pytest.approx(8.9 - 2.5)),
                   (2, "wet_raises_pore"): (False, -16.5), (2, "wet_raises_score"): (True, 40.0), (2, "floor_tail_rises"): (False, pytest.approx(8.9 - 25.0))}


def test_cap_rates(spark):
    rows = [(s, "ZONE_B", d, float(d) if s < 3 else 0.5) for s in range(4) for d in range(3)] + [(s, "ZONE_A", d, 0.1) for s in range(4) for d in range(3)]
    df = spark.createDataFrame(rows, "seed int, zone_code string, day_idx int, depth_m double").withColumn("cap", F.lit(2.0))
    got = {r["zone_code"]: (r["n_series"], r["cap_rate"], r["passed"]) for r in CT.cap_rates(df, ["seed"]).collect()}
    assert got == {"ZONE_A": (4, 0.0, True), "ZONE_B": (4, 0.75, False)}


def test_gates_find_a_broken_ladder_and_chain(spark):
    rows = [(i, 1, d, k, f, s, dens, base) for i, k, per in (
        ("a", "rainfall_storm", [(1.4, 40.0, 0.3, 0.3), (1.2, 50.0, 0.4, 0.35)]), ("b", "rainfall_storm", [(1.4, 40.0, 0.3, 0.3), (1.1, 60.0, 0.5, 0.35)]),
        ("c", "rainfall_storm", [(1.4, 40.0, 0.2, 0.3), (1.3, 70.0, 0.2, 0.35)])) for d, (f, s, dens, base) in enumerate(per)]
    runs = spark.createDataFrame(rows, "scenario_id string, zone_id int, day_idx int, kind_of_run string, fos double, instability_score double, density double, base_density double").withColumn("seed", F.lit(0))
    gate = lambda df: (lambda r: (r["gate"], r["checked_rows"], r["failed_rows"]))(df.first())
    assert gate(SC.dose_gate(runs, {"a": 1.0, "b": 2.0})) == ("dose_response", 1, 0)
    assert gate(SC.dose_gate(runs, {"a": 1.0, "b": 2.0, "c": 3.0})) == ("dose_response", 2, 1)
    assert gate(SC.continuity_gate(runs.where("scenario_id <> 'c'"))) == ("crack_continuity", 2, 0)
    assert gate(SC.continuity_gate(runs)) == ("crack_continuity", 3, 1)
    assert gate(SC.determinism_gate(runs, runs.orderBy("fos"))) == ("determinism", 3, 0)
    other = runs.withColumn("fos", F.when((F.col("scenario_id") == "b") & (F.col("day_idx") == 1), 1.0).otherwise(F.col("fos")))
    assert gate(SC.determinism_gate(runs, other)) == ("determinism", 3, 1)
    assert gate(SC.determinism_gate(runs, runs.where("scenario_id <> 'a'"))) == ("determinism", 3, 1)


def test_digests_find_the_groups_that_differ(spark):
    a = spark.range(1_000).select((F.col("id") % 10).alias("g"), F.col("id").alias("v"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("w"))
    assert SO.differing_groups(a, a.repartition(7), ["g"]).count() == 0
    cell = a.withColumn("w", F.when(F.col("v") == 123, None).otherwise(F.col("w")))
    twice = a.unionByName(a.where("v = 245"))
    less = a.where("g <> 6")
    for b, want in ((cell, [3]), (a.where("v <> 8"), [8]), (twice, [5]), (less, [6])):
        assert [r["g"] for r in SO.differing_groups(a, b, ["g"]).collect()] == [r["g"] for r in SO.differing_groups(b, a, ["g"]).collect()] == want
