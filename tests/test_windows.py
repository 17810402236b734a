import math

import pytest
from pyspark.sql import functions as F

from pitgauge.operators import windows as W
from pitgauge.operators.panel import conform, fill_daily_gaps, split_by_day


def series(spark, values, name="x", keys=(0, 1)):
    return spark.createDataFrame([(*keys, i, float(v)) for i, v in enumerate(values)], f"seed int, zone_id int, day_idx int, {name} double")


def column(df, col):
    return [r[0] for r in df.orderBy("seed", "zone_id", "day_idx").select(col).collect()]


def test_partial_and_full_frames_differ_at_the_head(spark):
    df, ws = series(spark, [1, 2, 3, 4]), W.series_window()
    assert column(df, W.trailing_sum("x", 3, ws)) == [1, 3, 6, 9]
    assert column(df, W.full_frame_sum("x", 3, ws)) == [None, None, 6, 9]
    assert column(df, W.trailing_max("x", 2, ws)) == [1, 2, 3, 4]


def test_changes_are_zero_at_the_head(spark):
    df, ws = series(spark, [5, 7, 4, 9]), W.series_window()
    assert column(df, W.k_day_change("x", 1, ws)) == [0, 2, -3, 5]
    assert column(df, W.k_day_change("x", 3, ws)) == [0, 0, 0, 4]
    assert column(series(spark, [2, -1, 3]), W.clipped_growth_sum("x", 2, ws)) == [2, 2, 3]


def test_runs_and_days_since(spark):
    df, ws = series(spark, [0, 0, 3, 4, 0, 1, 30, 0]), W.series_window()
    assert column(df, W.run_length(F.col("x") > 0, ws)) == [0, 0, 1, 2, 0, 1, 2, 0]
    assert column(df, W.run_length(F.col("x") == 0, ws)) == [1, 2, 0, 0, 1, 0, 0, 1]
    assert column(df, W.days_since(F.col("x") >= 25, ws)) == [1, 2, 3, 4, 5, 6, 0, 1]


def _memory(values, tau):
    out, m = [], 0.0
    for v in values:
        m = m * math.exp(-1 / tau) + v
        out.append(m)
    return out


@pytest.mark.parametrize("n,block", [(40, 2048), (5000, 512)])
def test_memory_matches_the_recurrence(spark, n, block):
    values = [(i * 37 % 11) * (i % 5 == 0) for i in range(n)]
    df = W.with_long_memory(series(spark, values), "x", "m", block_days=block)
    got, want = column(df, "m"), _memory(values, 12.0)
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9
    if n < 100:
        plain = column(series(spark, values), W.exponential_memory("x", W.series_window()))
        assert max(abs(a - b) for a, b in zip(plain, want)) < 1e-9


def test_memory_survives_long_series(spark):
    values = [1.0 if i % 100 == 0 else 0.0 for i in range(20000)]
    got = column(W.with_long_memory(series(spark, values), "x", "m"), "m")
    assert all(math.isfinite(v) for v in got)
    assert max(abs(a - b) for a, b in zip(got, _memory(values, 12.0))) < 1e-9


def test_capped_total_stays_at_the_cap(spark):
    df, ws = series(spark, [2] * 10), W.series_window()
    assert column(df, W.capped_total("x", 0.5, F.lit(6.0), ws)) == [1, 2, 3, 4, 5, 6, 6, 6, 6, 6]


@pytest.mark.parametrize("history,want", [
    ([50], "stable"), ([50, 60], "stable"), ([50, 58, 66], "rapidly_increasing"), ([50, 62, 75], "rapidly_increasing"),
    ([50, 57, 66], "rising"), ([50, 51, 51], "rising"), ([50, 47, 46], "stable")])
def test_trend(spark, history, want):
    assert column(series(spark, history), W.trend_of_last3("x", W.series_window()))[-1] == want


def test_strict_and_loose_crossings(spark):
    calm = [1.3] * 30 + [1.05, 0.9]
    ws = W.series_window()
    flags = lambda v, **k: column(series(spark, v), W.downward_crossing("x", ws, **k))
    assert flags(calm)[-1] is True
    assert flags(calm, calm=1.2)[-1] is False
    assert flags([1.3] * 31 + [0.9], calm=1.2, lookback=30)[-1] is True
    assert sum(flags([1.1] * 32 + [0.9], calm=1.2)) == 0


def test_warning_lead(spark):
    df, ws = series(spark, [10, 72, 10, 10, 80]), W.series_window()
    assert column(df, W.warning_lead(F.col("x") >= 70, ws, 10))[-1] == 3
    assert column(df, W.warning_lead(F.col("x") >= 70, ws, 2))[-1] is None


@pytest.mark.parametrize("n", [5, 400, 401, 1000])
def test_decimation_keeps_the_last_row(spark, n):
    days = [r.day_idx for r in W.decimate(series(spark, range(n)), 400).orderBy("day_idx").collect()]
    assert days[0] == 0 and days[-1] == n - 1 and len(days) <= 401


def test_sequences_need_the_full_length(spark):
    got = column(series(spark, range(16)), W.sequence_window(W.series_window(), ["x"]))
    assert [g is not None for g in got] == [False] * 13 + [True] * 3
    assert [r.x for r in got[-1]] == [float(i) for i in range(2, 16)]


def test_gaps_are_filled_between_start_and_end(spark):
    df = spark.createDataFrame([("a", "2024-01-03", 5.0), ("a", "2024-01-05", 7.0), ("b", "2024-01-01", 1.0)], "k string, d string, v double")
    df = df.select("k", F.to_date("d").alias("day"), "v")
    out = fill_daily_gaps(df, ["k"], "day", F.lit("2024-01-01").cast("date"), F.lit("2024-01-06").cast("date"), {"v": 0.0})
    got = {k: [r.v for r in out.where(F.col("k") == k).orderBy("day").collect()] for k in "ab"}
    assert got == {"a": [0, 0, 5, 0, 7, 0], "b": [1, 0, 0, 0, 0, 0]}


def test_features_share_one_exchange_and_ignore_the_future(spark):
    rows = [(s, z, d, float((d * 13 + z * 7) % 40), (d * z) % 3 > 0, float((d + s) % 9), 0.05 + 0.01 * d, float((d * 5 + z) % 4)) for s in (0, 1) for z in (1, 2) for d in range(40)]
    df = spark.createDataFrame(rows, "seed int, zone_id int, day_idx int, rainfall_mm double, wet_day boolean, groundwater_proxy double, crack_density double, ppv double")
    plan = W.temporal_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    gap = W.causality_gap(df, [3, 17, 31]).collect()
    assert [(r.n_series, r.n_failed) for r in gap] == [(4, 0)] * 3


def test_conform_adds_typed_nulls(spark):
    from pyspark.sql import types as T
    want = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.LongType())])
    out = conform(spark.createDataFrame([(1,)], "a int"), want)
    assert out.dtypes == [("b", "double"), ("a", "bigint")] and out.first() == (None, 1)


def test_day_split(spark):
    got = column(split_by_day(series(spark, range(4)), 1, 2), "split")
    assert got == ["train", "train", "validation", "test"]
