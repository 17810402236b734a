"""Streaming queries: the event table read as a file stream, final state compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgauge.functions import scoring as S
from pitgauge.plans.registry import R, query, rounded
from pitgauge.plans.score_plans import _DECT
from pitgauge.plans.sql import band, trend
from pitgauge.schemas import EVENTS_SCHEMA
from pitgauge.sources.readers import table_stream
from pitgauge.streaming import live as L

ORDER = ["micros", "event_id"]
_SCORED = """sc AS (SELECT event_id, user_id AS zone_id, epoch_us(ts) AS micros, CAST(ts AS DATE) AS day, least(100e0, 0.15e0 * value + CASE event_type WHEN 'error' THEN 40e0 WHEN 'purchase' THEN 20e0 ELSE 0e0 END) AS score FROM events)"""


def scored_readings(spark, folder):
    """Each reading scored on arrival, without state."""
    ev = table_stream(spark, folder, "events", EVENTS_SCHEMA)
    kind = F.col("event_type")
    bonus = F.when(kind == "error", 40.0).when(kind == "purchase", 20.0).otherwise(0.0)
    return ev.select("event_id", F.col("user_id").alias("zone_id"), F.col("ts").cast("timestamp").alias("event_time"),
                     F.least(F.lit(100.0), 0.15 * F.col("value") + bonus).alias("score")).withColumn("micros", F.unix_micros("event_time"))


@query("stream_latest_state", f"""WITH {_SCORED}, l AS (SELECT zone_id, event_id, score FROM sc QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY micros DESC, event_id DESC) = 1)
SELECT zone_id, event_id, {R('score')}, {band('score')} AS band FROM l""")
def stream_latest_state(spark, folder):
    t = L.latest_state(scored_readings(spark, folder).drop("event_time"), L.new_run_path(spark, "latest"), ORDER)
    return rounded(t.withColumn("band", S.score_band("score")), ["zone_id", "event_id", "band"], ["score"])


_TREND = f"""{_SCORED}, t AS (SELECT zone_id, score, {trend('zone_id', 'micros, event_id')} AS trend, row_number() OVER (PARTITION BY zone_id ORDER BY micros DESC, event_id DESC) AS rn,
 least(count(*) OVER (PARTITION BY zone_id), 12) AS n_history FROM sc)"""


@query("stream_trend", f"WITH {_TREND} SELECT zone_id, n_history, {R('score')}, trend, trend = 'rapidly_increasing' AS rapid FROM t WHERE rn = 1")
def stream_trend(spark, folder):
    h = L.score_history(scored_readings(spark, folder), L.new_run_path(spark, "trend"))
    return rounded(L.trend_now(h), ["zone_id", "n_history", "trend", "rapid"], ["score"])


@query("stream_trend_state", f"WITH {_TREND} SELECT zone_id, n_history, {R('score')}, trend, trend = 'rapidly_increasing' AS rapid FROM t WHERE rn = 1")
def stream_trend_state(spark, folder):
    t = L.trend_state(scored_readings(spark, folder), L.new_run_path(spark, "state"))
    return rounded(t, ["zone_id", "n_history", "trend", "rapid"], ["score"])


@query("stream_alerts", f"""WITH {_SCORED}, {_DECT}, h AS (SELECT DISTINCT zone_id, {band('score')} AS band FROM sc WHERE score >= 75)
SELECT zone_id, h.band, replace(message, '{{zone}}', 'Zone ' || zone_id) AS summary, action FROM h JOIN dec ON dec.band = h.band AND pos = 0""")
def stream_alerts(spark, folder):
    """One alert per zone and band; the table's readings lie within one window of 30 days."""
    return L.alerts(scored_readings(spark, folder), L.new_run_path(spark, "alerts")).drop("raised_at")


@query("stream_board", f"""WITH {_SCORED}, l AS (SELECT zone_id, score, {band('score')} AS band FROM sc QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY micros DESC, event_id DESC) = 1)
SELECT count(*) FILTER (WHERE band = 'Critical') AS n_critical, count(*) FILTER (WHERE band = 'High') AS n_high, count(*) FILTER (WHERE band = 'Moderate') AS n_moderate, count(*) FILTER (WHERE band IN ('Low', 'Very Low')) AS n_low,
 count(*) AS n_zones, CAST(floor(avg(floor(score / 100e0 * 100e0 + 0.5)) + 0.5) AS BIGINT) AS confidence_pct, CAST(0 AS BIGINT) AS people_in_hazard,
 CASE WHEN count(*) FILTER (WHERE band = 'Critical') > 0 THEN 'CRITICAL_ALERT' WHEN count(*) FILTER (WHERE band = 'High') > 0 THEN 'HIGH_ALERT' ELSE 'NORMAL_OPERATIONS' END AS status FROM l""")
def stream_board(spark, folder):
    return L.board_per_batch(scored_readings(spark, folder), L.new_run_path(spark, "board"))


@query("stream_daily_rollup", f"WITH {_SCORED} SELECT zone_id, day, count(*) AS n, {R('avg(score)', 6, 'mean_score')}, {R('max(score)', 6, 'max_score')} FROM sc GROUP BY 1, 2")
def stream_daily_rollup(spark, folder):
    """Readings per zone and day, whatever the order of files."""
    t = L.daily_rollup(scored_readings(spark, folder), "event_time", L.new_run_path(spark, "days")).whole()
    t = t.select("zone_id", "day", "n", (F.col("total") / F.col("n")).alias("mean_score"), F.col("top").alias("max_score"))
    return rounded(t, ["zone_id", "day", "n"], ["mean_score", "max_score"], 6)
