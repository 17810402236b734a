import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitgauge.functions import scoring as S
from pitgauge.operators import boards as B
from pitgauge.operators import evaluation as E
from pitgauge.operators import profile as PR
from pitgauge.operators import raster as RS
from pitgauge.operators import routing as RT
from pitgauge.operators import setops as SO
from pitgauge.operators import stats as ST
from pitgauge.operators.joins import dense_index, nearest_zone
from pitgauge.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("task_rows", [10**6, 40])
def test_quantiles_match_numpy_with_a_hot_group_and_a_hot_value(spark, task_rows):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 4}", 5.0 if i % 3 == 1 else round(rng.gauss(0, 10), 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, "v", probs, ["g"], task_rows=task_rows).collect()}
    for g in {r[0] for r in rows}:
        v = [x for k, x in rows if k == g]
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(v, p))
    whole = {r.prob: r.quantile for r in exact_quantiles(df, "v", probs, task_rows=task_rows).collect()}
    assert whole[0.25] == pytest.approx(np.quantile([v for _, v in rows], 0.25))


def test_nearest_zone_search_agrees_with_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, 0.5 if i % 3 else rng.random() * 10, 0.5 if i % 3 else rng.random() * 500) for i in range(300)]
    zs = [(i, rng.random() * 10, rng.random() * 50) for i in range(60)]
    p, z = spark.createDataFrame(pts, "point_id long, lat double, lng double"), spark.createDataFrame(zs, "zone_id long, lat double, lng double")
    want = {i: min(zs, key=lambda s: (np.sqrt((a - s[1]) ** 2 + (b - s[2]) ** 2), s[0]))[0] for i, a, b in pts}
    for rows in (50_000, 7):
        assert {r.point_id: r.zone_id for r in nearest_zone(p, z, cell_rows=rows).collect()} == want


def test_nearest_zone_loses_no_row(spark):
    nan, inf = float("nan"), float("inf")
    pts = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, None, 1.0), (3, nan, 1.0), (4, 5.0, inf), (None, 1.0, 1.0), (5, 9.0, 9.0)]
    p = spark.createDataFrame(pts, "point_id long, lat double, lng double")
    z = spark.createDataFrame([(7, 0.0, 1.0), (6, 1.0, 0.0), (8, 9.0, 9.5), (9, nan, 0.0), (5, None, None)], "zone_id long, lat double, lng double")
    got = sorted(((r.point_id or 0, r.zone_id or 0, -1 if r.dist is None else r.dist) for r in nearest_zone(p, z).collect()))
    assert got == [(0, 6, 1.0), (1, 6, 1.0), (1, 6, 1.0), (2, 0, -1), (3, 0, -1), (4, 0, -1), (5, 8, 0.5)]
    assert [r.zone_id for r in nearest_zone(p, z.limit(0)).collect()] == [None] * 7
    assert nearest_zone(p.limit(0), z).count() == 0


def test_quantiles_with_nan_and_infinities_equal_percentile(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, 5.0, nan)] + [("b", v) for v in (inf, inf, 1.0, -inf, None)] + [("c", nan), ("c", nan), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.4, 0.5, 0.8, 1.0]
    want = {(r.g, p): r.q[i] for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect() if r.q for i, p in enumerate(probs)}
    for task_rows in (1000, 2):
        got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, "v", probs, ["g"], task_rows=task_rows).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == want[k] or (np.isnan(got[k]) and np.isnan(want[k])) for k in want), (got, want)


def test_rows_outside_the_panel_are_left_out(spark):
    from pitgauge.operators.panel import fill_daily_gaps

    days = ["2023-12-20", "2023-12-29", "2024-01-02", "2024-01-01", "2024-01-04", "2024-02-01", None]
    df = spark.createDataFrame([("s", d, float(i)) for i, d in enumerate(days)] + [("t", "2023-12-31", 9.0)], "k string, d string, v double").select("k", F.to_date("d").alias("day"), "v")
    got = fill_daily_gaps(df, ["k"], "day", F.lit("2024-01-01").cast("date"), F.lit("2024-01-05").cast("date"), {"v": 0.0})
    assert sorted((r.k, str(r.day), r.v) for r in got.collect()) == [("s", "2024-01-01", 3.0), ("s", "2024-01-02", 2.0), ("s", "2024-01-03", 0.0), ("s", "2024-01-04", 4.0), ("s", "2024-01-05", 0.0)]


def test_scratch_tables_can_be_removed(spark, monkeypatch):
    import os

    from pitgauge import session

    monkeypatch.setattr(session, "_MADE", [])
    df = session.cut_lineage(spark.range(5))
    path = session._MADE[0]
    assert df.count() == 5 and os.path.isdir(path) and session.remove_scratch(spark) == 1 and not os.path.exists(path) and session._MADE == []


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    import types

    from pitgauge import session

    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *a: None), sparkContext=types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)


def test_dense_index_has_no_gaps(spark):
    df = dense_index(spark.range(1000), F.pmod(F.xxhash64("id"), F.lit(8)), ["id"])
    assert sorted(r.idx for r in df.collect()) == list(range(1000))


def test_top_days_prefers_the_earlier_day(spark):
    df = spark.createDataFrame([("S", "2024-01-02", 9.0), ("S", "2024-01-01", 9.0), ("S", "2024-01-03", 1.0)], "station_id string, d string, value double")
    df = df.withColumn("day", F.to_date("d"))
    assert [str(r.day) for r in PR.top_days(df, 2).collect()] == ["2024-01-01", "2024-01-02"]
    assert str(PR.top_event_share(df).first().day) == "2024-01-01"


def test_transition_probability_is_null_for_an_empty_class(spark):
    df = spark.createDataFrame([("S", f"2024-01-0{i}", 1.0) for i in range(1, 4)], "station_id string, d string, value double").withColumn("day", F.to_date("d"))
    r = PR.wet_dry_transitions(df, ["station_id"]).first()
    assert (r.p_wet, r.p_wet_after_wet, r.p_wet_after_dry) == (1.0, 1.0, None)


def test_partial_correlation_against_residuals(spark):
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=200), rng.normal(size=200)
    x, y = u + rng.normal(size=200), v - 0.5 * u + rng.normal(size=200)
    df = spark.createDataFrame([("g", *map(float, r)) for r in zip(x, y, u, v)], "g string, x double, y double, u double, v double")
    a = np.column_stack([u, v])
    rx, ry = (t - a @ np.linalg.lstsq(a, t, rcond=None)[0] for t in (x, y))
    assert ST.partial_correlation(df, "x", "y", "u", "v", ["g"]).first().partial_corr == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_levels_and_mode(spark):
    df = spark.createDataFrame([("z", "minor"), ("z", "severe"), ("z", "minor"), ("y", "normal")], "zone string, sev string")
    lv = {r.zone: (r.worst_level, r.second_worst_level) for r in ST.level_extremes(df, "sev", S.ordinal("sev", "crack_severity"), ["zone"]).collect()}
    assert lv == {"z": ("severe", "minor"), "y": ("normal", None)}
    assert {r.zone: r.mode_value for r in ST.most_frequent(df, "sev", ["zone"]).collect()} == {"z": "minor", "y": "normal"}


# ---------------------------------------------------------------- evaluation
def test_class_report_handles_absent_classes(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "a"), ("b", "d")], "y string, p string")
    rep = {r.label: r for r in E.class_report(pairs).collect()}
    assert rep["c"].precision == 0.0 and rep["c"].recall == 0.0 and rep["c"].f1 == 0.0
    assert rep["d"].support == 0 and rep["d"].recall == 0.0
    s = E.class_summary(E.class_report(pairs), "c").first()
    assert s.balanced_accuracy == pytest.approx((0.5 + 0.5 + 0) / 3) and s.accuracy == pytest.approx(2 / 6)


def test_probability_bins(spark):
    pairs = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 0.95), (1, 1.0)], "y int, p double")
    assert {r.bin: r.n for r in E.reliability(pairs).collect()} == {0: 1, 1: 1, 9: 2}


def test_bootstrap_of_identical_worlds_has_no_width(spark):
    pairs = spark.createDataFrame([(w, float(i), float(i) + 0.5) for w in range(5) for i in range(10)], "world int, y double, p double")
    b = E.cluster_bootstrap(pairs, "world", replicates=50).first()
    assert b.n_replicates == 50 and b.r2_low == pytest.approx(b.r2_high)


def test_constant_target_is_skipped(spark):
    pairs = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0)], "world int, y double, p double")
    assert E.regression_metrics(pairs).first().r2 is None
    assert E.cluster_bootstrap(pairs, "world", replicates=10).first().n_replicates == 0


# ---------------------------------------------------------------- equality
def test_multiset_difference_counts_repeats(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert {(r.x, r.n_left, r.n_right) for r in SO.multiset_difference(a, b).collect()} == {(1, 2, 1), (3, 0, 1)}
    assert SO.equality_report(a, a).first().is_equal


# ---------------------------------------------------------------- boards
def test_overrides_reject_unknown_fields(spark):
    base = spark.createDataFrame([("A", 1.0, 2.0), ("B", 3.0, 4.0)], "zone_id string, p double, q double")
    req = spark.createDataFrame([("A", {"p": 9.0}), ("B", {"p": 1.0, "bogus": 2.0})], "zone_id string, overrides map<string,double>")
    merged, bad = B.apply_overrides(base, req, "zone_id", ["p", "q"])
    assert [(r.zone_id, r.p, r.q) for r in merged.collect()] == [("A", 9.0, 2.0)]
    assert [(r.zone_id, r.unknown) for r in bad.collect()] == [("B", ["bogus"])]


def test_missing_evidence_lists_nulls_first(spark):
    df = spark.createDataFrame([(None, 1.0)], "ppv double, q double")
    got = df.select(B.missing_evidence(["ppv", "q"]).alias("g")).first().g
    assert got[0] == "ppv" and len(got) == 4


def test_decisions_name_their_own_zone(spark):
    z = spark.createDataFrame([("C", "Zone C", "Critical"), ("D", "Zone D", "Low")], "zone_id string, zone_name string, band string")
    d = B.decisions_by_band(z).collect()
    assert {r.role for r in d if r.zone_id == "C"} == {"worker", "safety_officer", "mine_manager", "rescue_team"}
    assert [r.message for r in d if r.zone_id == "C" and r.role == "worker"] == ["Avoid Zone C"]
    assert [r.priority for r in d if r.zone_id == "D" and r.role == "worker"] == ["normal"]


# ---------------------------------------------------------------- raster
def _cells(spark, a):
    return spark.createDataFrame([("T", i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "tile string, row long, col long, elev double")


@pytest.mark.parametrize("shape,size", [((3, 3), 256), ((11, 13), 4), ((9, 5), 1)])
def test_slope_and_relief_match_numpy(spark, shape, size):
    a = np.random.default_rng(1).normal(size=shape) * 10
    gy, gx = np.gradient(a)
    want = np.degrees(np.arctan(np.sqrt((gx / 2) ** 2 + (gy / 3) ** 2)))
    for r in RS.slope(_cells(spark, a), 2.0, 3.0, size).collect():
        assert r.slope_deg == pytest.approx(want[r.row, r.col])
    pad = np.pad(a, 1, mode="edge")
    got = RS.relief(_cells(spark, a), size).collect()
    assert len(got) == a.size
    for r in got:
        w = pad[r.row:r.row + 3, r.col:r.col + 3]
        assert r.relief == pytest.approx(w.max() - w.min())


def test_single_row_raster_uses_one_sided_edges(spark):
    got = {r.col: r.slope_deg for r in RS.slope(_cells(spark, np.array([[0.0, 1.0, 4.0, 9.0]]))).collect()}
    assert got[0] == pytest.approx(45.0) and got[3] == pytest.approx(np.degrees(np.arctan(5)))


def test_raster_uses_one_exchange(spark):
    plan = RS.slope(_cells(spark, np.zeros((2, 2))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# ---------------------------------------------------------------- routing
def _graph(spark):
    """Three ways from gate to plant: short and steep, level at the same risk-free cost twice (a tie), and a detour."""
    nodes = spark.createDataFrame([(n,) for n in ("gate", "cut", "ramp", "rim", "yard", "plant", "shed")], "node string")
    roads = spark.createDataFrame([(11, "gate", "cut", 40.0), (12, "cut", "plant", 35.0), (13, "gate", "ramp", 50.0), (14, "ramp", "plant", 52.0), (15, "gate", "rim", 50.0),
                                   (16, "rim", "plant", 52.0), (17, "gate", "yard", 90.0), (18, "yard", "plant", 95.0), (19, "gate", "moon", 5.0), (20, "cut", "ramp", -3.0)],
                                  "road_id int, src string, dst string, length double").withColumn("adjacent", F.lit(None).cast("array<string>"))
    risk = spark.createDataFrame([("gate", 5.0), ("cut", 80.0), ("ramp", 20.0), ("rim", 20.0), ("yard", 0.0), ("plant", 0.0), ("shed", 0.0)], "node string, risk double")
    return nodes, roads, risk


@pytest.mark.parametrize("hot", [10_000, 1])
def test_routes_around_a_risk(spark, hot):
    nodes, roads, risk = _graph(spark)
    edges = RT.with_worst_risk(RT.build_edges(nodes, roads), risk)
    req = spark.createDataFrame([("gate", "plant"), ("gate", "shed"), ("gate", "quay")], "src string, dst string")
    costs = {"length": F.col("length"), "risk": S.edge_cost("length", "worst", F.lit(0.02))}
    rt = RT.cheapest_paths(edges, req, costs, hot_degree=hot)
    r, = RT.compare_routes(rt, RT.exposure(rt, edges, risk)).collect()
    assert (r.base_path, r.base_cost, r.base_max_risk) == (["gate", "cut", "plant"], 75.0, 80.0)
    want = (50 + 52) * (1 + 0.02 * 20)
    assert r.aware_path in (["gate", "ramp", "plant"], ["gate", "rim", "plant"]) and r.aware_max_risk == 20.0 and r.avoided == ["cut"] and r.aware_cost == pytest.approx(want)
    assert {(u.dst, u.reason) for u in RT.unreachable(req, nodes, rt).collect()} == {("shed", "no route"), ("quay", "unknown endpoint")}
    assert {(u.road_id, u.reason) for u in RT.road_rejects(nodes, roads).collect()} == {(19, "unknown endpoint"), (20, "invalid length")}


def test_missing_risk_is_reported(spark):
    nodes, roads, risk = _graph(spark)
    edges = RT.with_worst_risk(RT.build_edges(nodes, roads), risk.where("node <> 'cut'"))
    assert {(r.src, r.dst) for r in RT.edges_without_risk(edges).collect()} == {("gate", "cut"), ("cut", "gate"), ("cut", "plant"), ("plant", "cut")}


def test_nearest_zone_copies_no_zone_through_the_driver(spark):
    """Forty zones at one position count as one, the smallest id wins, and the copied zones are merge-joined."""
    z = spark.createDataFrame([(40 * k + j, float(k), float(k % 3)) for k in range(12) for j in range(40)], "zone_id long, lat double, lng double")
    p = spark.createDataFrame([(i, i * 0.37, 1.0) for i in range(30)], "point_id long, lat double, lng double")
    out = nearest_zone(p, z)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 2
    want = {i: min((((i * 0.37 - k) ** 2 + (1.0 - k % 3) ** 2) ** 0.5, 40 * k) for k in range(12)) for i in range(30)}
    assert {r.point_id: (round(r.dist, 9), r.zone_id) for r in out.collect()} == {i: (round(d, 9), k) for i, (d, k) in want.items()}
