"""Contract rules over whole groups, and gates of scenario ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgauge.operators import contracts as CT
from pitgauge.operators import distribution as D
from pitgauge.operators import quality as Q
from pitgauge.operators import scenario as SC
from pitgauge.operators import windows as W
from pitgauge.operators.chain import recompute
from pitgauge.plans.registry import R, query, rounded
from pitgauge.plans.scenario_plans import run_sql
from pitgauge.plans.sql import ORDERS_DAILY, PANEL
from pitgauge.schemas import SCENARIO_SCHEMA, zones
from pitgauge.session import cut_lineage
from pitgauge.sources import adapters as A

_BASE = run_sql([("none", "none", 0, 0, {})]) + """,
b AS (SELECT *, 5 + (zone_id * 7 + day_idx * 13) % 23 AS hz, [40e0, 80e0, 200e0, 600e0][CAST(zone_id % 4 AS INTEGER) + 1] AS thrust, sum(rainfall_mm) OVER (PARTITION BY seed, zone_id ORDER BY day_idx ROWS 6 PRECEDING) AS r7d FROM runs)"""


def base_run(spark, folder):
    """The recomputed panel with its zones' thrust bands and a frequency for each day."""
    bands = zones(spark).select(F.col("zone_id").alias("zone_code"), "thrust_lo", "thrust_hi")
    run = recompute(A.site_panel(spark, folder), W.SERIES).join(bands, "zone_code")
    return cut_lineage(run.withColumn("frequency_hz", 5 + (F.col("zone_id") * 7 + F.col("day_idx") * 13) % 23))


_RATE = "7e0 * count(*) FILTER (WHERE blast_occurs AND zc = '{z}') / nullif(count(*) FILTER (WHERE zc = '{z}'), 0)"
_GROUP = [("confined_zone_highest", "td > ta AND td BETWEEN 490 AND 785", "td"), ("rate_conserved", "ra + rb BETWEEN 14 AND 28", "ra + rb"), ("rate_shared", "least(ra, rb) > 0", "least(ra, rb)"),
          ("rate_in_band_ZONE_A", "ra BETWEEN 5 AND 25", "ra"), ("many_events_ZONE_A", "na > 30", "na * 1e0"), ("rate_in_band_ZONE_B", "rb BETWEEN 5 AND 25", "rb"), ("many_events_ZONE_B", "nb > 30", "nb * 1e0"),
          ("low_frequency_share", "lf BETWEEN 0.30 AND 0.65", "lf"), ("score_anti_correlated", "c < -0.99", "c")]


@query("contract_group_rules", _BASE + f""",
gr AS (SELECT seed, max(thrust) FILTER (WHERE zc = 'ZONE_D') AS td, max(thrust) FILTER (WHERE zc = 'ZONE_A') AS ta, {_RATE.format(z='ZONE_A')} AS ra, {_RATE.format(z='ZONE_B')} AS rb,
 count(*) FILTER (WHERE blast_occurs AND zc = 'ZONE_A') AS na, count(*) FILTER (WHERE blast_occurs AND zc = 'ZONE_B') AS nb, avg(CASE WHEN hz < 8 THEN 1e0 ELSE 0e0 END) FILTER (WHERE blast_occurs) AS lf, corr(instability_score, fos) AS c FROM b GROUP BY seed)
""" + " UNION ALL ".join(f" SELECT seed, '{r}' AS rule_id, 'error' AS severity, coalesce({ok}, false) AS passed, {R(d, 4, 'detail')} FROM gr" for r, ok, d in _GROUP))
def contract_group_rules(spark, folder):
    """Thrust of the confined zone, blasting rates and frequencies, and the score's line, per world."""
    rules = CT.confined_rules() + CT.blast_rate_rules() + CT.score_rules()
    return rounded(Q.check_groups(base_run(spark, folder), rules, ["seed"]), ["seed", "rule_id", "severity", "passed"], ["detail"])


@query("contract_row_rules", _BASE + """ SELECT 'thrust_in_band' AS rule_id, 'error' AS severity, count(*) AS checked_rows,
 count(*) FILTER (WHERE NOT thrust BETWEEN [20e0, 40e0, 100e0, 490e0][CAST(zone_id % 4 AS INTEGER) + 1] AND [60e0, 120e0, 300e0, 785e0][CAST(zone_id % 4 AS INTEGER) + 1]) AS failed_rows,
 count(*) FILTER (WHERE NOT thrust BETWEEN [20e0, 40e0, 100e0, 490e0][CAST(zone_id % 4 AS INTEGER) + 1] AND [60e0, 120e0, 300e0, 785e0][CAST(zone_id % 4 AS INTEGER) + 1]) = 0 AS passed FROM b
 UNION ALL SELECT 'frequency_range', 'error', count(*) FILTER (WHERE blast_occurs), count(*) FILTER (WHERE blast_occurs AND NOT hz BETWEEN 5 AND 27), count(*) FILTER (WHERE blast_occurs AND NOT hz BETWEEN 5 AND 27) = 0 FROM b""")
def contract_row_rules(spark, folder):
    """Thrust inside its zone's band, frequencies of events inside theirs."""
    return Q.check_rows(base_run(spark, folder), CT.thrust_rules() + CT.frequency_rules())


_SPELLS = [("wet_raises_pore", "pore_kpa", 0.5, "true"), ("wet_raises_score", "instability_score", 0.5, "true"), ("floor_tail_rises", "pore_kpa", 0.9, "zc = 'ZONE_D'")]


@query("spell_rules", _BASE + ", s AS (" + " UNION ALL ".join(
    f"SELECT seed, '{r}' AS rule_id, quantile_cont({v}, {p}) FILTER (WHERE r7d > 30 AND {w}) - quantile_cont({v}, 0.5) FILTER (WHERE r7d < 5 AND {w}) AS gap FROM b GROUP BY seed" for r, v, p, w in _SPELLS)
    + f") SELECT seed, rule_id, 'error' AS severity, gap > 0 AS passed, {R('gap', 4, 'detail')} FROM s WHERE gap IS NOT NULL")
def spell_rules(spark, folder):
    """Wet spells against dry ones, per world."""
    return rounded(CT.spell_rules(base_run(spark, folder), ["seed"]), ["seed", "rule_id", "severity", "passed"], ["detail"])


@query("depth_cap_rate", _BASE + f""", p AS (SELECT zc AS zone_code, seed, zone_id, max(CASE WHEN depth_m >= cap - 1e-9 THEN 1e0 ELSE 0e0 END) AS hit FROM b GROUP BY ALL)
SELECT zone_code, count(*) AS n_series, {R('avg(hit)', 4, 'cap_rate')}, avg(hit) <= 0.65 AS passed FROM p GROUP BY zone_code""")
def depth_cap_rate(spark, folder):
    """How many series of each zone ever reach their depth cap; at most 65 percent may."""
    return rounded(CT.cap_rates(base_run(spark, folder), ["seed", "zone_id"]), ["zone_code", "n_series", "passed"], ["cap_rate"])


@query("season_order", f"""WITH {ORDERS_DAILY}, y AS (SELECT year(day) AS year, avg(value) FILTER (WHERE month(day) = 11) - avg(value) FILTER (WHERE month(day) = 2) AS gap FROM od GROUP BY 1)
SELECT CAST(year AS INTEGER) AS year, 'nov_above_feb' AS rule_id, 'error' AS severity, coalesce(gap > 0, false) AS passed, {R('gap', 4, 'detail')} FROM y""")
def season_order(spark, folder):
    """Whether November is above February in each year of the daily series; a year without one of them fails."""
    days = A.orders_daily(spark, folder).withColumns({"year": F.year("day"), "month": F.month("day")})
    return rounded(Q.check_groups(days, CT.season_rules("value"), ["year"]), ["year", "rule_id", "severity", "passed"], ["detail"])


@query("distribution_drift", f"""WITH {PANEL}, w AS (SELECT seed, day_idx < 15 AS early, round(rainfall_mm, 6) AS v FROM panel WHERE wet_day),
c AS (SELECT seed, v, count(*) FILTER (WHERE early) AS a, count(*) FILTER (WHERE NOT early) AS b FROM w GROUP BY 1, 2),
s AS (SELECT seed, sum(a) OVER o AS sa, sum(b) OVER o AS sb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM c WINDOW o AS (PARTITION BY seed ORDER BY v), p AS (PARTITION BY seed)),
d AS (SELECT seed, CAST(max(na) AS BIGINT) AS n_first, CAST(max(nb) AS BIGINT) AS n_second, max(abs(sa * 1e0 / nullif(na, 0) - sb * 1e0 / nullif(nb, 0))) AS distance FROM s GROUP BY seed)
SELECT seed, n_first, n_second, {R('distance', 6)}, distance > {D.LEVEL_1}e0 * sqrt((n_first + n_second) * 1e0 / (n_first * 1e0 * n_second)) AS differs FROM d""")
def distribution_drift(spark, folder):
    """Wet-day rain of the first days of each world against that of its later days, by Kolmogorov-Smirnov distance."""
    wet = A.events_panel(spark, folder).where("wet_day").select("seed", (F.col("day_idx") < 15).alias("early"), F.round("rainfall_mm", 6).alias("v"))
    return rounded(D.ks_distance(wet, "v", "early", ["seed"]), ["seed", "n_first", "n_second", "differs"], ["distance"], 6)


DOSES = {"storm_50": 50.0, "storm_100": 100.0, "storm_150": 150.0}
LADDER = [("none", "none", 0, 0, {}), *[(n, "rainfall_storm", 10, 7, {"peak_mm": d}) for n, d in DOSES.items()], ("soak", "prolonged_rain", 10, 15, {"daily_mm": 25.0})]
_DOSE_SQL = ", ".join(f"('{n}', {d}e0)" for n, d in DOSES.items())


@query("scenario_ladder_gates", run_sql(LADDER) + f""",
l AS (SELECT seed, zone_id, scenario_min_fos, scenario_peak, lag(scenario_min_fos) OVER w AS pf, lag(scenario_peak) OVER w AS pp FROM sm JOIN (VALUES {_DOSE_SQL}) v(scenario_id, dose) USING (scenario_id) WINDOW w AS (PARTITION BY seed, zone_id ORDER BY dose)),
st AS (SELECT scenario_id, seed, zone_id, day_idx, density, max(density) FILTER (WHERE scenario_id = 'none') OVER (PARTITION BY seed, zone_id, day_idx) AS base FROM runs),
inc AS (SELECT *, greatest(density - lag(density) OVER w, 0e0) AS up, greatest(base - lag(base) OVER w, 0e0) AS base_up, row_number() OVER w AS k FROM st WINDOW w AS (PARTITION BY scenario_id, seed, zone_id ORDER BY day_idx)),
cc AS (SELECT scenario_id, seed, zone_id, coalesce(sum(up), 0e0) >= coalesce(sum(base_up), 0e0) - 1e-9 AND bool_and(k > 1 OR abs(density - base) <= 1e-9) AS ok FROM inc WHERE scenario_id <> 'none' GROUP BY ALL)
SELECT 'dose_response' AS gate, count(*) AS checked_rows, count(*) FILTER (WHERE scenario_min_fos > pf + 1e-9 OR scenario_peak < pp - 1e-9) AS failed_rows FROM l WHERE pf IS NOT NULL
UNION ALL SELECT 'crack_continuity', count(*), count(*) FILTER (WHERE NOT ok) FROM cc UNION ALL SELECT 'determinism', count(DISTINCT scenario_id), CAST(0 AS BIGINT) FROM runs""")
def scenario_ladder_gates(spark, folder):
    """More of a driver never helps, cracks go on growing over a run's end, and a run repeated is the same."""
    table = spark.createDataFrame([(i, k, None, s, d, p, None) for i, k, s, d, p in LADDER], SCENARIO_SCHEMA)
    one, two = (SC.run(A.site_panel(spark, folder), table) for _ in range(2))
    one = cut_lineage(one)
    out = SC.dose_gate(one, DOSES).unionByName(SC.continuity_gate(one)).unionByName(SC.determinism_gate(one, two))
    return out.select("gate", "checked_rows", "failed_rows")

