"""Queries over the daily panel: features, memory, damage, trends, events, splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitgauge.functions import physics as P
from pitgauge.functions import scoring as S
from pitgauge.operators import panel as PN
from pitgauge.operators import stats as ST
from pitgauge.operators import windows as W
from pitgauge.operators.chain import crack_chain, with_rain_state
from pitgauge.plans.registry import R, Rs, query, rounded
from pitgauge.plans.sql import DENSE, LINEITEM_DAILY, ORDERS_DAILY, PANEL, PANEL_W, band, severity, trend
from pitgauge.sources import adapters as A
from pitgauge.sources import readers as RD

KEYS = ["seed", "zone_id", "day_idx"]


@query("panel_daily_dense", f"WITH {DENSE} SELECT seed, zone_id, day_idx, {R('rainfall_mm')}, wet_day, blast_occurs, {R('ppv')}, "
       f"inspected, err, {R('growth')} FROM dense")
def panel_daily_dense(spark, folder):
    return rounded(A.events_dense(spark, folder), [*KEYS, "wet_day", "blast_occurs", "inspected", "err"],
                   ["rainfall_mm", "ppv", "growth"])


@query("panel_contract_projection", f"""WITH {PANEL}
SELECT {R('rainfall_mm', alias='rainfall_24h_mm')}, {R('crack_density')}, {R('ppv', alias='blast_vibration_ppv_mms')},
       CAST(day_idx % 7 AS INTEGER) AS days_since_inspection, false AS prior_incident, {R('groundwater_proxy')},
       CAST(NULL AS VARCHAR) AS rock_type, seed, CAST(zone_id AS VARCHAR) AS zone_id, {R('score')} FROM panel""")
def panel_contract_projection(spark, folder):
    """Contract projection over the conformed panel; absent columns become typed nulls."""
    from pitgauge.schemas import STATE_SCHEMA
    internal = A.events_panel(spark, folder).withColumns({
        "blast_vibration_ppv_mms": F.col("ppv"), "prior_incident": F.lit(False),
        "days_since_inspection": P.inspection_clock("day_idx", 0, 7), "instability_score": F.col("score")})
    ml = PN.project_contract(PN.conform(internal, STATE_SCHEMA), extra=["seed", "zone_id", "instability_score"])
    scored = ml.withColumnRenamed("instability_score", "score")
    return rounded(scored, ["days_since_inspection", "prior_incident", "rock_type", "seed", "zone_id"],
                   ["rainfall_24h_mm", "crack_density", "blast_vibration_ppv_mms", "groundwater_proxy", "score"])


_O = "PARTITION BY seed, zone_id ORDER BY day_idx"


def _last(n: int) -> str:
    return f"OVER ({_O} ROWS {n - 1} PRECEDING)"


def _since(cond: str) -> str:
    so_far = f"OVER ({_O} ROWS UNBOUNDED PRECEDING)"
    return (f"CAST(day_idx - coalesce(max(CASE WHEN {cond} THEN day_idx END) {so_far}, "
            f"first_value(day_idx) {so_far} - 1) AS DOUBLE)")


def _change(x: str, k: int) -> str:
    return f"coalesce({x} - lag({x}, {k}) OVER w, 0e0)"


_HIT = "sum(CASE WHEN ppv > 0 THEN 1e0 ELSE 0e0 END)"
_FEATURES_SQL = f"""WITH {PANEL}, f1 AS (
 SELECT seed, zone_id, day_idx,
  sum(rainfall_mm) {_last(3)} AS rainfall_3d_mm, sum(rainfall_mm) {_last(14)} AS rainfall_14d_mm, max(rainfall_mm) {_last(7)} AS max_rainfall_7d_mm,
  {_since('NOT wet_day')} AS consecutive_wet_days, {_since('rainfall_mm >= 25')} AS days_since_heavy_rain,
  {_change('groundwater_proxy', 1)} AS gw_delta_1d, {_change('groundwater_proxy', 3)} AS gw_delta_3d,
  {_change('groundwater_proxy', 7)} AS gw_delta_7d, {_change('groundwater_proxy', 7)} / 7e0 AS gw_rise_rate_7d,
  {_change('crack_density', 1)} AS crack_growth_1d, {_change('crack_density', 3)} AS crack_growth_3d,
  {_change('crack_density', 7)} AS crack_growth_7d,
  max(ppv) {_last(3)} AS ppv_max_3d, max(ppv) {_last(7)} AS ppv_max_7d, {_HIT} {_last(3)} AS blast_count_3d,
  {_HIT} {_last(7)} AS blast_count_7d, sum(ppv) {_last(7)} AS cum_ppv_7d, {_since('ppv > 0')} AS days_since_last_blast
 FROM panel {PANEL_W}),
f2 AS (SELECT *, {_change('crack_growth_1d', 3)} AS crack_accel_3d, sum(greatest(crack_growth_1d, 0e0)) {_last(30)} AS cum_growth_30d
  FROM f1 {PANEL_W})
"""


@query("temporal_features", _FEATURES_SQL + f" SELECT seed, zone_id, day_idx, {Rs(W.TEMPORAL_FEATURES)} FROM f2")
def temporal_features(spark, folder):
    return rounded(W.temporal_features(A.events_panel(spark, folder)), KEYS, W.TEMPORAL_FEATURES)


@query("causality_selftest", f"""WITH {DENSE}
SELECT d.cut AS cut, count(*) AS n_series, 0e0 AS max_gap, CAST(0 AS BIGINT) AS n_failed
FROM dense, (SELECT CAST(unnest([5, 11, 17, 23]) AS INTEGER) AS cut) d WHERE dense.day_idx = d.cut GROUP BY d.cut""")
def causality_selftest(spark, folder):
    gap = W.causality_gap(A.events_panel(spark, folder), [5, 11, 17, 23])
    return gap.select("cut", "n_series", F.round("max_gap", 9).alias("max_gap"), "n_failed")


@query("rolling_full_frame", f"""WITH {ORDERS_DAILY}
SELECT station_id, day, {R('value', 6)},
  CASE WHEN row_number() OVER w >= 3 THEN round(sum(value) OVER (PARTITION BY station_id ORDER BY day ROWS 2 PRECEDING), 6) END AS sum_3d,
  CASE WHEN row_number() OVER w >= 7 THEN round(sum(value) OVER (PARTITION BY station_id ORDER BY day ROWS 6 PRECEDING), 6) END AS sum_7d
FROM od WINDOW w AS (PARTITION BY station_id ORDER BY day)""")
def rolling_full_frame(spark, folder):
    from pitgauge.operators.profile import rolling_totals
    return rounded(rolling_totals(A.orders_daily(spark, folder), (3, 7)), ["station_id", "day"], ["value", "sum_3d", "sum_7d"], 6)


_STATE = ("CASE WHEN k >= 0 AND k < 60 THEN 'dry' WHEN k >= 60 AND k < 150 THEN 'normal' WHEN k >= 150 AND k < 300 THEN 'elevated' "
          "WHEN k >= 300 AND k < 500 THEN 'high' ELSE 'critical' END")


@query("wetting_memory", f"""WITH {PANEL}, m AS (SELECT seed, zone_id, day_idx, groundwater_proxy, 20e0 + zone_id % 4 * 150e0 + groundwater_proxy AS k, rainfall_mm FROM panel)
SELECT seed, zone_id, day_idx, {R('groundwater_proxy')}, {R('k', alias='pore_pressure_kpa')}, {_STATE} AS groundwater_state,
 CASE WHEN rainfall_mm <= 0 THEN 'dry' WHEN rainfall_mm <= 35.5 THEN 'normal' WHEN rainfall_mm <= 64.5 THEN 'wet' ELSE 'storm' END AS rainfall_regime FROM m""")
def wetting_memory(spark, folder):
    thrust = 20.0 + (F.col("zone_id") % 4) * 150.0
    kpa = P.pore_pressure(thrust, "groundwater_proxy")
    p = A.events_panel(spark, folder).withColumns({
        "pore_pressure_kpa": kpa, "groundwater_state": P.groundwater_state(kpa), "rainfall_regime": P.rain_regime("rainfall_mm")})
    return rounded(p, [*KEYS, "groundwater_state", "rainfall_regime"], ["groundwater_proxy", "pore_pressure_kpa"])


def damage_ctes(src: str = "panel", keys: str = "seed, zone_id") -> str:
    """The crack chain in SQL over a panel-shaped relation; the last relation is ``damage``."""
    o = f"PARTITION BY {keys} ORDER BY day_idx"
    zone = "[CAST(zone_id % 4 AS INTEGER) + 1]"
    return f"""
r AS (SELECT *, day_idx - coalesce(max(CASE WHEN wet_day THEN day_idx END) OVER ({o} ROWS UNBOUNDED PRECEDING),
        first_value(day_idx) OVER ({o} ROWS UNBOUNDED PRECEDING) - 1) AS dry_days,
      sum(rainfall_mm) OVER ({o} ROWS 6 PRECEDING) AS r7,
      ['ZONE_A','ZONE_B','ZONE_C','ZONE_D']{zone} AS zc, [25e0, 18e0, 6e0, 0e0]{zone} AS bench_h, [60e0, 55e0, 75e0, 5e0]{zone} AS slope,
      [0.75e0, 0.55e0, 0.3e0, 1e0]{zone} AS weakness, [0.4e0, 0.45e0, 0.2e0, 1e0]{zone} AS clay FROM {src}),
t0 AS (SELECT *, least(greatest(groundwater_proxy / 60e0, 0e0), 3e0) AS wn, 0.5e0 + 0.5e0 * weakness AS s,
      CASE WHEN zc = 'ZONE_D' THEN 1e0 ELSE 0.4e0 * bench_h END AS cap FROM r),
t AS (SELECT *,
  0.18e0 * greatest(slope / 75e0, 0e0) * s * (0.15e0 + 0.85e0 * least(greatest(wn / 1.5e0, 0e0), 1e0)) AS tension,
  0.6e0 * wn * s AS hydraulic,
  CASE WHEN zc IN ('ZONE_A','ZONE_B') AND blast_occurs AND ppv > 10 THEN 0.8e0 * greatest((ppv - 10e0) / 12.5e0, 0e0) ELSE 0e0 END AS blast,
  CASE WHEN zc = 'ZONE_B' AND groundwater_proxy > 60 THEN 0.45e0 * wn ELSE 0e0 END AS seepage,
  CASE WHEN clay > 0.5 AND dry_days >= 14 AND zc <> 'ZONE_D' THEN 0.15e0 * clay * least(greatest(dry_days / 30e0, 0e0), 1e0) ELSE 0e0 END AS desiccation,
  CASE WHEN zc = 'ZONE_D' THEN 0.5e0 * greatest(600e0 / 490e0 - 1e0, 0e0) * (0.5e0 + 0.5e0 * wn) ELSE 0e0 END AS heave FROM t0),
g AS (SELECT *, tension + hydraulic + blast + seepage + desiccation + heave AS growth_mm FROM t),
d AS (SELECT *, least(CASE WHEN zc = 'ZONE_D' THEN 60e0 ELSE 150e0 END, sum(growth_mm * 0.85e0) OVER ({o} ROWS UNBOUNDED PRECEDING)) AS width_mm,
      least(cap, sum(growth_mm * 0.012e0) OVER ({o} ROWS UNBOUNDED PRECEDING)) AS depth_m FROM g),
damage AS (SELECT *, wet_day OR r7 > 15 OR groundwater_proxy > 60 AS water_filled, {severity('depth_m / greatest(cap, 1e-6)')} AS crack_severity,
  least(greatest(0.3e0 + 0.4e0 * least(greatest(depth_m / greatest(cap, 1e-6) * 2e0, 0e0), 1e0) + 0.2e0 * least(greatest(growth_mm / 10e0, 0e0), 1e0), 0.05e0), 2.5e0) AS density,
  CASE WHEN NOT (depth_m > 0.05 OR width_mm > 1) THEN 'none' WHEN zc = 'ZONE_D' THEN 'floor_heave'
       WHEN tension >= greatest(hydraulic, blast, seepage, desiccation, 0e0) THEN 'tension_crest'
       WHEN hydraulic >= greatest(blast, seepage, desiccation, 0e0) THEN 'tension_crest'
       WHEN blast >= greatest(seepage, desiccation, 0e0) THEN 'blast_induced'
       WHEN seepage >= greatest(desiccation, 0e0) THEN 'seepage'
       WHEN desiccation >= 0e0 THEN 'desiccation' ELSE 'tension_crest' END AS crack_family FROM d)"""


_DAMAGE_SQL = f"WITH {PANEL}, {damage_ctes()}"


def damage_panel(spark, folder):
    """Events panel with zones assigned round-robin and the crack chain computed on it."""
    ws = W.series_window()
    sited = A.with_site_attributes(A.events_panel(spark, folder))
    return crack_chain(with_rain_state(sited, ws), ws)


@query("capped_damage", _DAMAGE_SQL + f" SELECT seed, zone_id, day_idx, {R('growth_mm')}, {R('width_mm')}, {R('depth_m')}, {R('density')}, "
       "water_filled, crack_severity, crack_family FROM damage")
def capped_damage(spark, folder):
    return rounded(damage_panel(spark, folder), [*KEYS, "water_filled", "crack_severity", "crack_family"],
                   ["growth_mm", "width_mm", "depth_m", "density"])


@query("trend_last3", f"WITH {PANEL} SELECT seed, zone_id, day_idx, {R('score')}, {trend()} AS trend, {band('score')} AS band FROM panel")
def trend_last3(spark, folder):
    p = A.events_panel(spark, folder).withColumns({"trend": W.trend_of_last3("score", W.series_window()), "band": S.score_band("score")})
    return rounded(p, [*KEYS, "trend", "band"], ["score"])


@query("history_last12", f"""WITH {PANEL}
SELECT seed, zone_id, day_idx, count(*) OVER h AS n_history, {R('first_value(score) OVER h', alias='oldest_score')},
 {R('sum(score) OVER h', alias='sum_score')}, {R('max(score) OVER h', alias='max_score')}
FROM panel WINDOW h AS (PARTITION BY seed, zone_id ORDER BY day_idx ROWS 11 PRECEDING)""")
def history_last12(spark, folder):
    """The last twelve scores as an array, emitted as its size, ends and sums."""
    p = A.events_panel(spark, folder).withColumn("history", W.recent_history(W.series_window(), "day_idx", "score"))
    h = F.col("history")
    out = p.withColumns({"n_history": F.size(h).cast("long"), "oldest_score": h[0]["score"],
                         "sum_score": F.aggregate(h, F.lit(0.0), lambda a, x: a + x["score"]),
                         "max_score": F.array_max(F.transform(h, lambda x: x["score"]))})
    return rounded(out, [*KEYS, "n_history"], ["oldest_score", "sum_score", "max_score"])


_CROSS = f"""WITH {PANEL}, f AS (SELECT *, (100e0 - score) / 50e0 AS fos FROM panel),
x AS (SELECT seed, zone_id, day_idx, fos, score,
  coalesce(fos < 1 AND lag(fos) OVER w >= 1, false) AS loose,
  coalesce(fos < 1 AND lag(fos) OVER w >= 1 AND row_number() OVER w > 5
    AND min(fos) OVER (PARTITION BY seed, zone_id ORDER BY day_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 1.1, false) AS strict,
  coalesce({band('score')} <> lag({band('score')}) OVER w, false) AS band_change,
  min(CASE WHEN score >= 40 THEN day_idx END) OVER (PARTITION BY seed, zone_id ORDER BY day_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS warned
 FROM f WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx))"""


def crossing_flags(spark, folder):
    ws = W.series_window()
    p = A.events_panel(spark, folder).withColumns({"fos": (100.0 - F.col("score")) / 50.0, "band": S.score_band("score")})
    return p.select(
        *KEYS, "fos", "score", W.downward_crossing("fos", ws, from_position=0).alias("loose"),
        W.downward_crossing("fos", ws, calm=1.1, lookback=5, from_position=5).alias("strict"),
        W.changed("band", ws).alias("band_change"),
        W.warning_lead(F.col("score") >= 40, ws, 10).alias("lead_days"))


@query("crossings", _CROSS + """ SELECT seed, count(*) FILTER (WHERE loose) AS n_loose, count(*) FILTER (WHERE strict) AS n_strict,
 count(*) FILTER (WHERE band_change) AS n_band_changes FROM x GROUP BY seed""")
def crossings(spark, folder):
    return crossing_flags(spark, folder).groupBy("seed").agg(
        F.count_if("loose").alias("n_loose"), F.count_if("strict").alias("n_strict"), F.count_if("band_change").alias("n_band_changes"))


@query("strict_crossings", f"""WITH {LINEITEM_DAILY}, m AS (SELECT *, sum(value) OVER (PARTITION BY series ORDER BY day ROWS 6 PRECEDING) / (5.6e0 * avg(value) OVER (PARTITION BY series)) AS fos FROM ld),
x AS (SELECT series, coalesce(fos < 1 AND lag(fos) OVER w >= 1 AND row_number() OVER w > 30, false) AS loose,
  coalesce(fos < 1 AND lag(fos) OVER w >= 1 AND row_number() OVER w > 30 AND min(fos) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) >= 1.2, false) AS strict,
  coalesce(fos < 1 AND lag(fos) OVER w >= 1 AND row_number() OVER w > 31 AND min(fos) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) >= 1.2, false) AS strict_31
 FROM m WINDOW w AS (PARTITION BY series ORDER BY day))
SELECT series, count(*) AS n_days, count(*) FILTER (WHERE loose) AS n_loose, count(*) FILTER (WHERE strict) AS n_strict, count(*) FILTER (WHERE strict_31) AS n_strict_31 FROM x GROUP BY series""")
def strict_crossings(spark, folder):
    """The contract's rule, 30 earlier days at 1.2 or more (from day 30 and from day 31), over the long daily series: a week's sum against four fifths of its mean."""
    ws, whole = W.series_window(["series"], "day"), Window.partitionBy("series")
    s = A.lineitem_daily(spark, folder).withColumn("fos", W.trailing_sum("value", 7, ws) / (5.6 * F.avg("value").over(whole)))
    flags = s.select("series", W.downward_crossing("fos", ws).alias("loose"), W.downward_crossing("fos", ws, calm=1.2).alias("strict"),
                     W.downward_crossing("fos", ws, calm=1.2, from_position=31).alias("strict_31"))
    return flags.groupBy("series").agg(F.count(F.lit(1)).alias("n_days"), *[F.count_if(c).alias(f"n_{c}") for c in ("loose", "strict", "strict_31")])


@query("warning_lead", _CROSS + f""" SELECT seed, count(*) AS n_events, count(warned) AS n_detected,
 {R('count(warned) * 1e0 / count(*)', alias='detection_rate')}, round(avg(day_idx - warned), 4) AS mean_lead_days,
 CAST(max(day_idx - warned) AS INTEGER) AS max_lead_days FROM x WHERE strict GROUP BY seed""")
def warning_lead(spark, folder):
    ev = crossing_flags(spark, folder).where("strict")
    return ev.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n_events"), F.count("lead_days").alias("n_detected"),
        F.round(F.count("lead_days") / F.count(F.lit(1)), 4).alias("detection_rate"),
        F.round(F.avg("lead_days"), 4).alias("mean_lead_days"), F.max("lead_days").alias("max_lead_days"))


_EVIDENCE = _DAMAGE_SQL + """, e AS (SELECT seed, zone_id, day_idx, score, lag(score) OVER w AS prev,
  CASE WHEN rainfall_mm - lag(rainfall_mm) OVER w >= 10 THEN 1 ELSE 0 END AS c1,
  CASE WHEN groundwater_proxy - lag(groundwater_proxy) OVER w >= 15 THEN 1 ELSE 0 END AS c2,
  CASE WHEN crack_severity <> lag(crack_severity) OVER w THEN 1 ELSE 0 END AS c3,
  CASE WHEN blast_occurs THEN 1 ELSE 0 END AS c4,
  CASE WHEN water_filled AND NOT lag(water_filled) OVER w THEN 1 ELSE 0 END AS c5,
  CASE WHEN crack_severity <> lag(crack_severity) OVER w THEN 'crack severity ' || lag(crack_severity) OVER w || ' -> ' || crack_severity ELSE '' END AS sev_text
 FROM damage WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx)),
k AS (SELECT *, c1 + c2 + c3 + c4 + c5 AS n, row_number() OVER (PARTITION BY seed, zone_id ORDER BY day_idx) AS rn
      FROM e WHERE prev IS NOT NULL AND abs(score - prev) >= 3 AND c1 + c2 + c3 + c4 + c5 > 0)"""


@query("evidence_timeline", _EVIDENCE + f""" SELECT seed, zone_id, day_idx, {R('prev', 1, 'score_from')}, {R('score', 1, 'score_to')},
 CAST(n AS INTEGER) AS n_causes, c1 = 1 AS rain_cause, c2 = 1 AS groundwater_cause, sev_text, c5 = 1 AS filled_cause FROM k WHERE rn <= 25""")
def evidence_timeline(spark, folder):
    """Score moves of at least 3 with an attributed cause; the first 25 per series."""
    out = evidence_events(damage_panel(spark, folder))
    has = lambda prefix: F.exists("causes", lambda c: c.startswith(prefix))
    sev = F.coalesce(F.get(F.filter("causes", lambda c: c.startswith("crack severity")), F.lit(0)), F.lit(""))
    return out.select(*KEYS, F.round("score_from", 1).alias("score_from"), F.round("score_to", 1).alias("score_to"),
                      F.size("causes").alias("n_causes"), has("heavy rainfall").alias("rain_cause"),
                      has("groundwater proxy").alias("groundwater_cause"), sev.alias("sev_text"),
                      has("cracks became").alias("filled_cause"))


def evidence_events(df, min_move: float = 3.0, limit: int = 25, keys=("seed", "zone_id")):
    ws = W.series_window(keys)
    lag = lambda c: F.lag(c).over(ws)
    moves = df.select(
        *keys, "day_idx", lag("score").alias("score_from"), F.col("score").alias("score_to"),
        S.cause_strings(d_rain=F.col("rainfall_mm") - lag("rainfall_mm"), d_proxy=F.col("groundwater_proxy") - lag("groundwater_proxy"),
                        sev_prev=lag("crack_severity"), sev_cur="crack_severity", blast="blast_occurs", ppv="ppv",
                        filled_prev=lag("water_filled"), filled_cur="water_filled").alias("causes"))
    hit = moves.where((F.abs(F.col("score_to") - F.col("score_from")) >= min_move) & (F.size("causes") > 0))
    return hit.withColumn("_rn", F.row_number().over(ws)).where(F.col("_rn") <= limit).drop("_rn")


@query("decimated_trajectory", f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY seed, zone_id) AS n FROM panel {PANEL_W})
SELECT seed, zone_id, day_idx, {R('score')} FROM n WHERE pos % greatest(CAST(ceil(n / 7e0) AS BIGINT), 1) = 0 OR pos = n - 1""")
def decimated_trajectory(spark, folder):
    return rounded(W.decimate(A.events_panel(spark, folder), 7), KEYS, ["score"])


@query("sequence_windows", f"""WITH {PANEL} SELECT seed, zone_id, day_idx, {R('sum(score) OVER h', alias='sum_score')}, {R('sum(rainfall_mm) OVER h', alias='sum_rain')},
 {R('first_value(groundwater_proxy) OVER h', alias='first_proxy')} FROM panel
 WINDOW h AS (PARTITION BY seed, zone_id ORDER BY day_idx ROWS 13 PRECEDING) QUALIFY count(*) OVER h = 14""")
def sequence_windows(spark, folder):
    """14-day feature windows; emitted as sums of the arrays."""
    p = A.events_panel(spark, folder)
    win = W.sequence_window(W.series_window(), ["rainfall_mm", "groundwater_proxy", "score"])
    out = p.withColumn("win", win).where(F.col("win").isNotNull()).withColumns({
        "sum_score": F.aggregate("win", F.lit(0.0), lambda a, x: a + x["score"]),
        "sum_rain": F.aggregate("win", F.lit(0.0), lambda a, x: a + x["rainfall_mm"]),
        "first_proxy": F.col("win")[0]["groundwater_proxy"]})
    return rounded(out, KEYS, ["sum_score", "sum_rain", "first_proxy"])


@query("future_target_persistence", f"""WITH {PANEL}, h AS (SELECT 1 AS horizon, score AS p, lead(score, 1) OVER w AS y FROM panel {PANEL_W}
 UNION ALL SELECT 7, score, lead(score, 7) OVER w FROM panel {PANEL_W})
SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS n, {R('avg(abs(y - p))', alias='mae')}, {R('sqrt(avg((y - p) * (y - p)))', alias='rmse')},
 {R('1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*))', alias='r2')} FROM h WHERE y IS NOT NULL GROUP BY horizon""")
def future_target_persistence(spark, folder):
    """Scores 1 and 7 days ahead against carrying today's score forward."""
    from pitgauge.operators.evaluation import regression_metrics
    ws = W.series_window()
    p = A.events_panel(spark, folder).select(
        "score", W.future_value("score", 1, ws).alias("y1"), W.future_value("score", 7, ws).alias("y7"))
    pairs = p.select(F.inline(F.array(
        F.struct(F.lit(1).alias("horizon"), F.col("y1").alias("y"), F.col("score").alias("p")),
        F.struct(F.lit(7).alias("horizon"), F.col("y7").alias("y"), F.col("score").alias("p"))))).where("y is not null")
    return rounded(regression_metrics(pairs, ["horizon"]), ["horizon", "n"], ["mae", "rmse", "r2"])


@query("chronological_split", f"""WITH {PANEL} SELECT CASE WHEN day_idx <= 19 THEN 'train' WHEN day_idx <= 24 THEN 'validation' ELSE 'test' END AS split,
 count(*) AS n, {R('avg(score)', alias='mean_score')}, count(*) FILTER (WHERE score >= 75) AS n_events FROM panel GROUP BY 1""")
def chronological_split(spark, folder):
    p = PN.split_by_day(A.events_panel(spark, folder), 19, 24)
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"),
                                  F.sum(S.event_flag("score")).alias("n_events"))


@query("random_row_split", f"""WITH {PANEL} SELECT CASE WHEN (zone_id * 7919 + day_idx * 104729) % 1000003 % 100 < 20 THEN 'test' ELSE 'train' END AS split,
 count(*) AS n, count(DISTINCT seed) AS n_worlds, {R('avg(score)', alias='mean_score')} FROM panel GROUP BY 1""")
def random_row_split(spark, folder):
    """Row-level split: both sides see every world, which is the leak it demonstrates."""
    draw = F.pmod(F.col("zone_id") * 7919 + F.col("day_idx") * 104729, F.lit(1000003))
    p = PN.split_by_row(A.events_panel(spark, folder), draw, 20)
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seed").alias("n_worlds"),
                                  F.round(F.avg("score"), 4).alias("mean_score"))


@query("zone_baseline_delta", f"""WITH {PANEL}, s AS (SELECT *, zone_id % 7 AS zone, 2.5e0 - score / 50e0 AS fos,
  CASE WHEN seed IN (0, 1, 2) THEN 'train' WHEN seed = 3 THEN 'validation' ELSE 'test' END AS split FROM panel),
 b AS (SELECT zone, min(score) AS base_score, max(fos) AS base_fos FROM s WHERE split = 'train' GROUP BY zone)
SELECT s.zone, split, count(*) AS n, {R('avg(score - base_score)', alias='delta_score')}, {R('avg(fos - base_fos)', alias='delta_fos')}
FROM s LEFT JOIN b USING (zone) GROUP BY s.zone, split""")
def zone_baseline_delta(spark, folder):
    p = A.events_panel(spark, folder).withColumns({"zone": F.col("zone_id") % 7, "fos": 2.5 - F.col("score") / 50.0})
    p = PN.split_by_group(p, "seed", {"train": [0, 1, 2], "validation": [3], "test": [4]})
    d = ST.with_deltas(p, ST.group_baselines(p, "zone"), "zone")
    return d.groupBy("zone", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta_score"), 4).alias("delta_score"),
                                          F.round(F.avg("delta_fos"), 4).alias("delta_fos"))


@query("minewide_series_join", f"""WITH {PANEL}, m AS (SELECT day_idx, sum(rainfall_mm) AS site_rain FROM panel GROUP BY day_idx)
SELECT seed, day_idx, count(*) AS n_zones, {R('max(site_rain)', alias='site_rain')}, {R('sum(rainfall_mm) / nullif(max(site_rain), 0)', alias='share')}
FROM panel JOIN m USING (day_idx) GROUP BY seed, day_idx""")
def minewide_series_join(spark, folder):
    """A site-wide daily series joined onto every zone's day."""
    from pitgauge.operators.joins import lookup
    p = A.events_panel(spark, folder)
    site = p.groupBy("day_idx").agg(F.sum("rainfall_mm").alias("site_rain"))
    j = lookup(p, site, "day_idx", "inner")
    g = j.groupBy("seed", "day_idx").agg(F.count(F.lit(1)).alias("n_zones"), F.max("site_rain").alias("site_rain"),
                                         (F.sum("rainfall_mm") / F.nullif(F.max("site_rain"), F.lit(0.0))).alias("share"))
    return rounded(g, ["seed", "day_idx", "n_zones"], ["site_rain", "share"])


@query("zone_bootstrap", f"""WITH {PANEL} SELECT zone_id, arg_max(day_idx, day_idx) AS day_idx, {R('arg_max(score, day_idx)', alias='score')},
 {R('arg_max(groundwater_proxy, day_idx)', alias='groundwater_proxy')} FROM panel WHERE seed = 3 GROUP BY zone_id""")
def zone_bootstrap(spark, folder):
    return rounded(RD.latest_states(A.events_panel(spark, folder), seed=3), ["zone_id", "day_idx"], ["score", "groundwater_proxy"])


@query("daily_history_labels", f"""WITH {PANEL} SELECT zone_id, strftime(DATE '2024-01-01' + day_idx, '%b %d') AS label, day_idx, {R('score', 1)} FROM panel WHERE seed = 1""")
def daily_history_labels(spark, folder):
    """Score history of one world with calendar labels."""
    p = A.events_panel(spark, folder).where("seed = 1")
    return p.select("zone_id", S.day_label(F.lit(A.PANEL_START), "day_idx").alias("label"), "day_idx", F.round("score", 1).alias("score"))


@query("autocorr", f"""WITH {LINEITEM_DAILY}, d AS (SELECT series, day_idx, value - avg(value) OVER (PARTITION BY series) AS d FROM ld),
 p AS (SELECT *, lag(d) OVER (PARTITION BY series ORDER BY day_idx) AS p FROM d)
SELECT series, {R('sum(d * p) / sum(d * d)', alias='lag1_autocorr')} FROM p GROUP BY series""")
def autocorr(spark, folder):
    return rounded(ST.autocorrelation(A.lineitem_daily(spark, folder), "value", ["series"]), ["series"], ["lag1_autocorr"])
