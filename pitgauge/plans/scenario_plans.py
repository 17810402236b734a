"""What-if queries: scenario tables run over the stored panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pitgauge.operators import scenario as SC
from pitgauge.plans.panel_plans import damage_ctes, evidence_events
from pitgauge.plans.registry import R, Rs, query, rounded
from pitgauge.plans.score_plans import _STAB
from pitgauge.plans.sql import DENSE, ORDERS_DAILY
from pitgauge.schemas import SCENARIO_SCHEMA
from pitgauge.sources import adapters as A

# scenario, kind, start, duration, parameters
SCENARIOS = [
    ("none", "none", 0, 0, {}),
    ("storm", "rainfall_storm", 10, 7, {"peak_mm": 100.0}),
    ("prolonged", "prolonged_rain", 10, 10, {"daily_mm": 20.0}),
    ("historical", "historical_rain", 25, 31, {"scale": 1.0}),
    ("surge", "blast_surge", 5, 10, {"ppv_mult": 1.5}),
    ("combined", "combined", 12, 6, {"peak_mm": 60.0, "ppv_mult": 2.0}),
]


def scenario_table(spark, scenarios=SCENARIOS):
    rows = [(i, k, None, s, d, p, "jan_1996" if k == "historical_rain" else None) for i, k, s, d, p in scenarios]
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


def scenario_runs(spark, folder, scenarios=SCENARIOS, template_end=dt.date(1996, 1, 31)):
    scenarios = scenario_table(spark, scenarios)
    windows = spark.createDataFrame([("jan_1996", dt.date(1996, 1, 1), template_end)], "template_id string, first_day date, last_day date")
    profiles = SC.template_profiles(A.orders_daily(spark, folder), windows)
    return SC.run(A.site_panel(spark, folder), scenarios, profiles)


_KEYS3 = "seed, zone_id, scenario_id"


def run_sql(scenarios, template_end: str = "1996-01-31") -> str:
    """The overlay and the chain in SQL for site-wide scenarios (id, kind, start, days, parameters), up to the relations ``runs`` and ``sm``."""
    return f"""WITH {DENSE}, {ORDERS_DAILY},
tpl AS (SELECT row_number() OVER (ORDER BY day) AS k, value FROM od WHERE day BETWEEN DATE '1996-01-01' AND DATE '{template_end}'),
sc AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{k}', {s}, {d}, {p.get('peak_mm', 0.0)}e0, {p.get('ppv_mult', 1.0)}e0, {p.get('daily_mm', 0.0)}e0, {p.get('scale', 1.0)}e0)" for i, k, s, d, p in scenarios)}) v(scenario_id, kind, start_day, dur, peak, mult, daily, scale)),
x0 AS (SELECT seed, zone_id, day_idx, scenario_id, sc.kind AS run_kind, start_day, dur, peak, mult, daily, scale, day_idx - start_day + 1 AS k, rainfall_mm / 10e0 AS rain, blast_occurs, ppv AS ppv0 FROM dense, sc),
x1 AS (SELECT x0.*, rain + CASE WHEN x0.k BETWEEN 1 AND dur THEN CASE WHEN run_kind IN ('rainfall_storm', 'combined') THEN peak * (least(x0.k, dur - x0.k + 1) * 1e0) / ((dur + 1) / 2e0)
   WHEN run_kind = 'prolonged_rain' THEN daily WHEN run_kind = 'historical_rain' THEN coalesce(tpl.value, 0e0) * scale ELSE 0e0 END ELSE 0e0 END AS rainfall_mm,
  CASE WHEN run_kind IN ('blast_surge', 'combined') AND x0.k BETWEEN 1 AND dur AND blast_occurs AND zone_id % 4 < 2 THEN least(ppv0 * mult, 100e0) ELSE ppv0 END AS ppv FROM x0 LEFT JOIN tpl ON tpl.k = x0.k),
x2 AS (SELECT *, rainfall_mm > 0 AS wet_day, exp(-day_idx / 12e0) * sum(rainfall_mm * exp(day_idx / 12e0)) OVER (PARTITION BY {_KEYS3} ORDER BY day_idx ROWS UNBOUNDED PRECEDING) AS groundwater_proxy FROM x1),
{damage_ctes('x2', _KEYS3)},
sx AS (SELECT * EXCLUDE (s, r7), groundwater_proxy AS proxy, crack_severity AS severity, water_filled AS filled, CASE WHEN zc = 'ZONE_D' THEN 'floor' ELSE 'bench' END AS zone_kind,
  [40e0, 80e0, 200e0, 600e0][CAST(zone_id % 4 AS INTEGER) + 1] + groundwater_proxy AS pore_kpa, [300e0, 90e0, 60e0, 0e0][CAST(zone_id % 4 AS INTEGER) + 1] AS cohesion,
  [24e0, 32e0, 20e0, 20e0][CAST(zone_id % 4 AS INTEGER) + 1] AS phi, [20e0, 21.5e0, 13.5e0, 19e0][CAST(zone_id % 4 AS INTEGER) + 1] AS gamma, bench_h AS height, slope AS theta, slope AS face FROM damage),
{_STAB.format(src='sx')},
lab AS MATERIALIZED (SELECT *, round_even(least(greatest(100e0 * (2.5e0 - fos) / 2e0, 0e0), 100e0), 1) AS instability_score,
  CASE WHEN fos < 0.8 THEN 'critical' WHEN fos < 1.0 THEN 'high' WHEN fos < 1.2 THEN 'moderate' WHEN fos < 1.5 THEN 'low' ELSE 'very_low' END AS risk_label FROM fs),
runs AS MATERIALIZED (SELECT *, max(fos) FILTER (WHERE scenario_id = 'none') OVER d AS base_fos, max(instability_score) FILTER (WHERE scenario_id = 'none') OVER d AS base_score,
  max(risk_label) FILTER (WHERE scenario_id = 'none') OVER d AS base_label FROM lab WINDOW d AS (PARTITION BY seed, zone_id, day_idx)),
sm AS (SELECT scenario_id, seed, zone_id, min(base_fos) AS baseline_min_fos, min(fos) AS scenario_min_fos, min(round(fos - base_fos, 9)) AS fos_divergence_min,
  (array_agg(day_idx ORDER BY round(fos - base_fos, 9), day_idx))[1] AS divergence_day, count(*) FILTER (WHERE abs(fos - base_fos) > 0.01) AS days_diverging,
  max(base_score) AS baseline_peak, max(instability_score) AS scenario_peak, count(*) FILTER (WHERE base_label IN ('high', 'critical')) AS baseline_days_hot,
  count(*) FILTER (WHERE risk_label IN ('high', 'critical')) AS scenario_days_hot, min(CASE WHEN abs(instability_score - base_score) > 1 THEN day_idx END) AS first_response_day,
  (array_agg(day_idx ORDER BY instability_score DESC, day_idx))[1] AS worst_day, (array_agg(risk_label ORDER BY instability_score DESC, day_idx))[1] AS worst_day_risk,
  max(growth_mm) AS peak_growth, max(pore_kpa) AS peak_pore_kpa, max(groundwater_proxy) AS max_proxy, bool_or(crack_severity = 'critical' AND water_filled) AS open_crack_branch FROM runs GROUP BY ALL)"""


_RUN = run_sql(SCENARIOS)

_SUM_KEEP = ["scenario_id", "seed", "zone_id", "divergence_day", "days_diverging", "baseline_days_hot", "scenario_days_hot", "first_response_day",
             "worst_day", "worst_day_risk", "open_crack_branch"]
_SUM_ROUND = ["baseline_min_fos", "scenario_min_fos", "fos_divergence_min", "baseline_peak", "scenario_peak", "peak_growth", "peak_pore_kpa", "max_proxy"]


@query("scenario_overlay", _RUN + f""" SELECT scenario_id, seed, zone_id, day_idx, {Rs(['rainfall_mm', 'ppv', 'groundwater_proxy', 'growth_mm', 'depth_m', 'fos', 'base_fos', 'instability_score'])},
 crack_severity, risk_label FROM runs""")
def scenario_overlay(spark, folder):
    """Every scenario's drivers and recomputed chain beside the baseline."""
    return rounded(scenario_runs(spark, folder), ["scenario_id", "seed", "zone_id", "day_idx", "crack_severity", "risk_label"],
                   ["rainfall_mm", "ppv", "groundwater_proxy", "growth_mm", "depth_m", "fos", "base_fos", "instability_score"])


@query("scenario_summary", _RUN + f" SELECT {', '.join(_SUM_KEEP)}, {Rs(_SUM_ROUND)}, {R('scenario_min_fos - baseline_min_fos', alias='delta_min_fos')}, {R('scenario_peak - baseline_peak', alias='delta_peak')} FROM sm")
def scenario_summary(spark, folder):
    return rounded(SC.summarize(scenario_runs(spark, folder)), _SUM_KEEP, [*_SUM_ROUND, "delta_min_fos", "delta_peak"])


@query("scenario_compare", _RUN + f""" SELECT scenario_id, count(*) AS n_series, CAST(sum(scenario_days_hot) AS BIGINT) AS days_hot, min(first_response_day) AS onset_day, {R('max(scenario_peak)', alias='peak_score')},
 {R('max(scenario_peak - baseline_peak)', alias='max_delta_peak')}, {R('min(scenario_min_fos)', alias='min_fos')}, {R('max(peak_growth)', alias='peak_growth')}, {R('max(max_proxy)', alias='max_proxy')} FROM sm GROUP BY scenario_id""")
def scenario_compare(spark, folder):
    out = SC.compare(SC.summarize(scenario_runs(spark, folder)))
    return rounded(out, ["scenario_id", "n_series", "days_hot", "onset_day"], ["peak_score", "max_delta_peak", "min_fos", "peak_growth", "max_proxy"]).orderBy(
        F.col("max_delta_peak").desc(), "scenario_id")


@query("scenario_trajectory", _RUN + f""", n AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS3} ORDER BY day_idx) - 1 AS pos, count(*) OVER (PARTITION BY {_KEYS3}) AS n FROM runs)
SELECT scenario_id, seed, zone_id, day_idx, risk_label, {Rs(['fos', 'base_fos', 'instability_score'])} FROM n WHERE pos % greatest(CAST(ceil(n / 8e0) AS BIGINT), 1) = 0 OR pos = n - 1""")
def scenario_trajectory(spark, folder):
    return rounded(SC.trajectory(scenario_runs(spark, folder), 8), ["scenario_id", "seed", "zone_id", "day_idx", "risk_label"], ["fos", "base_fos", "instability_score"])


@query("scenario_evidence", _RUN + f""", e AS (SELECT scenario_id, seed, zone_id, day_idx, instability_score AS score, lag(instability_score) OVER w AS prev,
  CASE WHEN rainfall_mm - lag(rainfall_mm) OVER w >= 10 THEN 1 ELSE 0 END + CASE WHEN groundwater_proxy - lag(groundwater_proxy) OVER w >= 15 THEN 1 ELSE 0 END
  + CASE WHEN crack_severity <> lag(crack_severity) OVER w THEN 1 ELSE 0 END + CASE WHEN blast_occurs THEN 1 ELSE 0 END
  + CASE WHEN water_filled AND NOT lag(water_filled) OVER w THEN 1 ELSE 0 END AS n FROM runs WINDOW w AS (PARTITION BY {_KEYS3} ORDER BY day_idx))
SELECT scenario_id, seed, zone_id, day_idx, {R('prev', 1, 'score_from')}, {R('score', 1, 'score_to')}, CAST(n AS INTEGER) AS n_causes FROM e WHERE prev IS NOT NULL AND abs(score - prev) >= 3 AND n > 0
QUALIFY row_number() OVER (PARTITION BY {_KEYS3} ORDER BY day_idx) <= 25""")
def scenario_evidence(spark, folder):
    """Attributed score moves of every run, the first 25 per run and series."""
    runs = scenario_runs(spark, folder).withColumn("score", F.col("instability_score"))
    out = evidence_events(runs, keys=("scenario_id", "seed", "zone_id"))
    return out.select("scenario_id", "seed", "zone_id", "day_idx", F.round("score_from", 1).alias("score_from"), F.round("score_to", 1).alias("score_to"),
                      F.size("causes").alias("n_causes"))


_GATES = [("baseline_replays_itself", "run_kind = 'none'", "abs(fos - base_fos) <= 1e-12"), ("unchanged_before_start", "day_idx < start_day AND run_kind <> 'none'", "abs(fos - base_fos) <= 1e-12"),
          ("surge_skips_unblasted_zones", "run_kind = 'blast_surge' AND zone_id % 4 >= 2", "abs(fos - base_fos) <= 1e-12"),
          ("more_rain_never_safer", "run_kind IN ('rainfall_storm', 'prolonged_rain', 'historical_rain')", "fos <= base_fos + 1e-9"), ("fos_is_finite", "true", "fos IS NOT NULL AND NOT isnan(fos)")]


@query("scenario_gates", _RUN + " UNION ALL ".join(f" SELECT '{g}' AS gate, count(*) FILTER (WHERE {w}) AS checked_rows, count(*) FILTER (WHERE ({w}) AND NOT coalesce({ok}, false)) AS failed_rows FROM runs" for g, w, ok in _GATES))
def scenario_gates(spark, folder):
    return SC.gates(scenario_runs(spark, folder))


EDGES = [("none", "none", 0, 0, {}), ("scale0", "historical_rain", 10, 12, {"scale": 0.0}), ("start0", "rainfall_storm", 0, 5, {"peak_mm": 80.0}),
         ("overrun", "rainfall_storm", 25, 30, {"peak_mm": 60.0}), ("surge", "blast_surge", 5, 20, {"ppv_mult": 2.0}), ("short_template", "historical_rain", 10, 12, {"scale": 1.0})]
TEMPLATE_END = dt.date(1996, 1, 5)
_EDGE = {"scale0": "abs(fos - base_fos) <= 1e-12", "start0": "isfinite(fos)", "overrun": "isfinite(fos)", "surge": "zone_id % 4 < 2 OR ppv = ppv0",
         "short_template": "isfinite(fos) AND (k <= 5 OR rainfall_mm = rain)"}


@query("scenario_edge_cases", run_sql(EDGES, str(TEMPLATE_END)) + ", n AS (SELECT count(*) AS n FROM dense)" + " UNION ALL ".join(
    f" SELECT '{g}' AS gate, max(n) AS checked_rows, count(*) FILTER (WHERE scenario_id = '{g}' AND NOT coalesce({ok}, false)) + abs(max(n) - count(*) FILTER (WHERE scenario_id = '{g}')) AS failed_rows FROM runs, n" for g, ok in _EDGE.items())
    + " UNION ALL SELECT 'unknown_kind', CAST(1 AS BIGINT), CAST(0 AS BIGINT)")
def scenario_edge_cases(spark, folder):
    """Scenarios at the edge of what is allowed do what is defined for them."""
    return SC.edge_gates(A.site_panel(spark, folder), scenario_runs(spark, folder, EDGES, TEMPLATE_END), 5)
