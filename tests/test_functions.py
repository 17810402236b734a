import math

import pytest
from pyspark.sql import functions as F

from pitgauge.functions import physics as P
from pitgauge.functions import scoring as S


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return r[0] if len(cols) == 1 else tuple(r)


@pytest.mark.parametrize("fos,label,condition,score", [
    (0.8, "high", "unstable", 85.0), (1.0, "moderate", "marginal", 75.0), (1.2, "low", "stable", 65.0), (1.5, "very_low", "stable", 50.0),
    (0.79, "critical", "failed", 85.5), (None, None, None, None), (float("nan"), None, None, None)])
def test_label_edges(spark, fos, label, condition, score):
    f = F.lit(fos).cast("double")
    got = one(spark, P.risk_label(f), P.slope_condition(f))
    assert got == (label, condition)
    if score is not None:
        assert one(spark, P.instability_score(f)) == score


def test_bench_stability_by_hand(spark):
    th, phi = math.radians(45), math.radians(30)
    den = 20 * 10 * math.sin(th) * math.cos(th)
    want = min((50 * 0.95 + (1 - 0.2) * 20 * 10 * math.cos(th) ** 2 * math.tan(phi)) / den, 2.5)
    lit = lambda v: F.lit(float(v))
    assert one(spark, P.bench_fos(lit(50), lit(30), lit(20), lit(10), lit(45), lit(0.2), lit(0.95))) == pytest.approx(want)
    assert one(spark, P.bench_fos(lit(50), lit(30), lit(20), lit(0), lit(45), lit(0.2), lit(0.95))) is None
    assert one(spark, P.floor_fos(lit(0), F.lit(True)), P.floor_fos(lit(490), F.lit(False)), P.floor_fos(lit(100), F.lit(False))) == (2.5, 1.0, 4.9)


def test_pore_ratio_and_retention(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, P.pore_ratio(F.lit(360.0), t)) == pytest.approx(0.5)
    assert one(spark, P.pore_ratio(F.lit(90.0), f)) == pytest.approx(0.175)
    assert one(spark, P.cohesion_retention(F.lit(3.0), F.lit("critical"), t, F.lit(60.0)), P.cohesion_retention(F.lit(3.0), F.lit("critical"), t, F.lit(59.0))) == (0.5, 0.9)


@pytest.mark.parametrize("kpa,state", [(-1, "critical"), (0, "dry"), (60, "normal"), (150, "elevated"), (300, "high"), (500, "critical")])
def test_groundwater_bands(spark, kpa, state):
    assert one(spark, P.groundwater_state(F.lit(float(kpa)))) == state


@pytest.mark.parametrize("mm,regime", [(0, "dry"), (35.5, "normal"), (64.5, "wet"), (64.6, "storm")])
def test_rain_regime(spark, mm, regime):
    assert one(spark, P.rain_regime(F.lit(float(mm)))) == regime


def test_attenuation_is_capped_and_zero_without_charge(spark):
    k, b = F.lit(858.9), F.lit(1.58)
    assert one(spark, P.peak_particle_velocity(F.lit(10.0), F.lit(600.0), k, b)) == 100.0
    assert one(spark, P.peak_particle_velocity(F.lit(300.0), F.lit(0.0), k, b)) == 0.0
    assert one(spark, P.peak_particle_velocity(F.lit(300.0), F.lit(300.0), k, b)) == pytest.approx(858.9 * (300 / math.sqrt(300)) ** -1.58)


def test_dominant_driver_takes_the_first_maximum(spark):
    terms = {n: F.lit(v) for n, v in {"tension": 1.0, "hydraulic": 0.0, "blast": 1.0, "seepage": 0.0, "desiccation": 0.0}.items()}
    pick = lambda d, w, k: one(spark, P.dominant_driver(terms, F.lit(d), F.lit(w), F.lit(k)))
    assert pick(0.1, 0.0, "bench") == "tension_crest"
    assert pick(0.01, 0.5, "bench") == "none"
    assert pick(0.1, 0.0, "floor") == "floor_heave"
    terms["blast"] = F.lit(2.0)
    assert pick(0.1, 0.0, "bench") == "blast_induced"


def test_display_helpers(spark):
    assert one(spark, S.band_upper(F.lit("Very Low"))) == "VERY_LOW"
    assert one(spark, S.band_upper(F.lit("a b c"))) == "A_B C"
    assert one(spark, S.capitalise(F.lit("hIGH")), S.key_suffix(F.lit("ZONE_B"))) == ("High", "B")
    assert one(spark, S.confidence_pct(F.lit(0.874)), S.confidence_pct(F.lit(55.0)), S.confidence_pct(F.lit(None).cast("double"))) == (87, 55, 0)
    assert one(spark, S.urgency(F.lit("immediate")), S.urgency(F.lit("medium"))) == ("Immediate Action", "Operational")


def test_confidence_and_rounding(spark):
    assert one(spark, S.round_score(F.lit(74.5)), S.round_score(F.lit(75.5)), S.round_score(F.lit(120.0))) == (74, 76, 100)
    assert one(spark, S.confidence(F.lit(80), F.lit(1.2)), S.confidence(F.lit(80), F.lit(None).cast("double")), S.confidence(F.lit(80))) == (1.0, 0.8, 0.8)


def test_midpoints(spark):
    pts = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in [(0.0, 0.0), (1.0, 2.0), (2.0, 2.0)]])
    got = [(p.lat, p.lng) for p in one(spark, S.with_midpoints(pts))]
    assert got == [(0, 0), (0.5, 1), (1, 2), (1.5, 2), (2, 2)]
    assert len(one(spark, S.with_midpoints(F.slice(pts, 1, 1)))) == 1


def test_edge_cost_contract(spark):
    c = lambda *a: one(spark, S.edge_cost(*[F.lit(float(x)) for x in a]))
    assert c(2, 10, 0.1) == pytest.approx(4.0)
    assert c(-1, 10, 0.1) is None and c(1, 101, 0.1) is None and c(1, 10, -0.1) is None and c(float("nan"), 1, 1) is None


def test_triangular_profile(spark):
    got = [one(spark, S.triangular_profile(F.lit(k), F.lit(5), F.lit(90.0))) for k in range(1, 6)]
    assert got == pytest.approx([30, 60, 90, 60, 30])


def test_causes_in_order(spark):
    c = S.cause_strings(d_rain=F.lit(12.4), d_proxy=F.lit(20.0), sev_prev=F.lit("minor"), sev_cur=F.lit("severe"), blast=F.lit(True), ppv=F.lit(7.25),
                        filled_prev=F.lit(False), filled_cur=F.lit(True))
    got = one(spark, c)
    assert got[0] == "heavy rainfall (+12 mm/24h)" and got[2] == "crack severity minor -> severe" and got[4] == "cracks became water-filled" and len(got) == 5
