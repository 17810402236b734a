"""Queries over slopes, materials, vibration, decisions, boards and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgauge.functions import physics as P
from pitgauge.functions import scoring as S
from pitgauge.operators import boards as B
from pitgauge.operators import windows as W
from pitgauge.operators.joins import lookup, missing_keys, nearest_zone
from pitgauge.plans.registry import R, Rs, query, rounded
from pitgauge.plans.sql import PANEL, SLOPES, band, trend
from pitgauge.schemas import DECISIONS, ENUMS, MATERIALS, PROVENANCE_GAPS, blast_constants, materials, zones
from pitgauge.sources import adapters as A
from pitgauge.sources import readers as RD


@query("deteriorating_fastest", f"""WITH {PANEL}, t AS (SELECT seed, zone_id, day_idx, score, {trend()} AS trend, score - lag(score, 3) OVER w AS change_3d,
 sum(rainfall_mm) OVER (PARTITION BY seed, zone_id ORDER BY day_idx ROWS 6 PRECEDING) AS rain_7d, groundwater_proxy FROM panel WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx))
SELECT seed, zone_id, {band('score')} AS band, trend, {Rs(['score', 'change_3d', 'rain_7d', 'groundwater_proxy'])} FROM t
WHERE day_idx = (SELECT max(day_idx) FROM panel) ORDER BY round(t.change_3d, 4) DESC, zone_id LIMIT 20""")
def deteriorating_fastest(spark, folder):
    """Flagship: the twenty series whose score rose most over the last three days."""
    ws = W.series_window()
    p = A.events_panel(spark, folder)
    t = p.select("seed", "zone_id", "day_idx", "score", W.trend_of_last3("score", ws).alias("trend"), S.score_band("score").alias("band"),
                 (F.col("score") - F.lag("score", 3).over(ws)).alias("change_3d"), W.trailing_sum("rainfall_mm", 7, ws).alias("rain_7d"),
                 "groundwater_proxy", F.lead("day_idx").over(ws).alias("_next"))
    last = t.where("_next is null")
    out = rounded(last, ["seed", "zone_id", "band", "trend"], ["score", "change_3d", "rain_7d", "groundwater_proxy"])
    return out.orderBy(F.col("change_3d").desc(), "zone_id").limit(20)


# ---------------------------------------------------------------- slope physics
_STAB = """ru AS (SELECT *, least(greatest(0.35e0 * least(greatest(proxy / 180e0, 0e0), 1e0) + CASE WHEN filled THEN 0.15e0 ELSE 0e0 END, 0e0), 0.55e0) AS r_u,
  CASE WHEN severity = 'critical' AND filled AND face >= 60 THEN 0.5e0 ELSE 1e0 - 0.10e0 * least(density, 1e0) END AS retention FROM {src}),
fs AS (SELECT *, CASE WHEN zone_kind = 'floor' THEN CASE WHEN pore_kpa <= 0 THEN 2.5e0 ELSE 490e0 / (pore_kpa * (1e0 + CASE WHEN filled THEN 0.15e0 ELSE 0e0 END)) END
  ELSE least((cohesion * retention + (1e0 - r_u) * gamma * height * pow(cos(radians(theta)), 2) * tan(radians(phi))) / (gamma * height * sin(radians(theta)) * cos(radians(theta))), 2.5e0) END AS fos FROM ru)"""
_LABEL = "CASE WHEN fos < 0.8 THEN 'critical' WHEN fos < 1.0 THEN 'high' WHEN fos < 1.2 THEN 'moderate' WHEN fos < 1.5 THEN 'low' ELSE 'very_low' END"
_COND = "CASE WHEN fos < 0.8 THEN 'failed' WHEN fos < 1.0 THEN 'unstable' WHEN fos < 1.2 THEN 'marginal' ELSE 'stable' END"
_SCORE = "round_even(least(greatest(100e0 * (2.5e0 - fos) / 2e0, 0e0), 100e0), 1)"


def with_stability(df):
    return df.withColumns(P.stability_columns("cohesion", "phi", "gamma", "height", "theta", "face", "proxy", "density", "severity",
                                              "filled", "pore_kpa", "zone_kind"))


@query("fos_score_bands", f"""WITH {SLOPES}, {_STAB.format(src='slopes')} SELECT slope_id, {Rs(['r_u', 'retention', 'fos'], 7)}, {_LABEL} AS risk_label, {_COND} AS slope_condition,
 {_SCORE} AS instability_score, {band(_SCORE)} AS band FROM fs""")
def fos_score_bands(spark, folder):
    s = with_stability(A.slope_attributes(spark, folder)).withColumns({
        "risk_label": P.risk_label("fos"), "slope_condition": P.slope_condition("fos"), "instability_score": P.instability_score("fos")})
    s = s.withColumn("band", S.score_band("instability_score"))
    return rounded(s, ["slope_id", "risk_label", "slope_condition", "instability_score", "band"], ["r_u", "retention", "fos"], 7)


@query("score_confidence", f"""WITH {SLOPES}, {_STAB.format(src='slopes')}, raw AS (SELECT slope_id, least(greatest(100e0 * (2.5e0 - fos) / 2e0, 0e0), 100e0) AS raw FROM fs)
SELECT slope_id, {R('raw')}, CAST(round_even(raw, 0) AS INTEGER) AS score, round_even(CASE WHEN slope_id % 3 = 0 THEN least(greatest(raw / 80e0, 0e0), 1e0) ELSE least(greatest(round_even(raw, 0) / 100e0, 0e0), 1e0) END, 3) AS confidence FROM raw""")
def score_confidence(spark, folder):
    """Clamped integer score; calibrated confidence where known, else score/100."""
    s = with_stability(A.slope_attributes(spark, folder)).withColumn("raw", P.instability_raw("fos"))
    s = s.withColumn("score", S.round_score("raw")).withColumn(
        "confidence", S.confidence("score", F.when(F.col("slope_id") % 3 == 0, F.col("raw") / 80.0)))
    return s.select("slope_id", F.round("raw", 4).alias("raw"), "score", "confidence")


@query("fos_sensitivity", f"""WITH {SLOPES} SELECT slope_id, {R('-tan(radians(phi)) / tan(radians(theta))', alias='per_pore_ratio')},
 {R('0.1e0 * cohesion / (gamma * height * sin(radians(theta)) * cos(radians(theta)))', alias='per_tenth_retention')} FROM slopes""")
def fos_sensitivity(spark, folder):
    s = A.slope_attributes(spark, folder).select("slope_id", P.fos_per_pore_ratio("phi", "theta").alias("per_pore_ratio"),
                                                P.fos_per_tenth_retention("cohesion", "gamma", "height", "theta").alias("per_tenth_retention"))
    return rounded(s, ["slope_id"], ["per_pore_ratio", "per_tenth_retention"])


# state name, proxy, density, severity, filled
_STATES = [("dry", 0.0, 0.0, "normal", False), ("wet", 180.0, 0.0, "normal", False), ("cracked", 180.0, 0.7, "moderate", True),
           ("open", 180.0, 0.9, "critical", True), ("blast", 180.0, 1.0, "critical", True)]


@query("counterfactual_states", f"""WITH {SLOPES}, st AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {p}e0, {d}e0, '{s}', {str(f).lower()})" for n, p, d, s, f in _STATES)}) v(state, proxy, density, severity, filled)),
 x AS (SELECT s.* EXCLUDE (proxy, density, severity, filled), st.* FROM slopes s, st), {_STAB.format(src='x')}
SELECT slope_id, state, {R('fos')}, {_LABEL} AS risk_label FROM fs""")
def counterfactual_states(spark, folder):
    """Every slope in five reference states (dry, wet, cracked, open crack, blast-damaged)."""
    return rounded(state_table(A.slope_attributes(spark, folder)).withColumn("risk_label", P.risk_label("fos")), ["slope_id", "state", "risk_label"], ["fos"])


def state_table(slopes):
    states = F.array(*[F.struct(F.lit(n).alias("state"), F.lit(p).alias("proxy"), F.lit(d).alias("density"), F.lit(s).alias("severity"),
                                F.lit(f).alias("filled")) for n, p, d, s, f in _STATES])
    kept = [c for c in slopes.columns if c not in ("proxy", "density", "severity", "filled")]
    return with_stability(slopes.select(*kept, F.inline(states)))


@query("physics_sweep", f"""WITH {SLOPES}, sw AS (SELECT s.* EXCLUDE (proxy), g.step, 20e0 * g.step AS proxy FROM slopes s, (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS step) g), {_STAB.format(src='sw')},
 d AS (SELECT slope_id, step, fos, fos - lag(fos) OVER (PARTITION BY slope_id ORDER BY step) AS step_change FROM fs)
SELECT slope_id, {R('min(fos)', alias='min_fos')}, {R('max(fos)', alias='max_fos')}, coalesce(max(step_change), 0) <= 1e-9 AS never_rises FROM d GROUP BY slope_id""")
def physics_sweep(spark, folder):
    """Stability along a 12-point groundwater grid per slope; it may never rise with wetting.

    The grid is an array transformed inside the row, so the sweep needs no shuffle.
    """
    s = A.slope_attributes(spark, folder)
    retention = P.cohesion_retention("density", "severity", "filled", "face")

    def fos_at(step):
        r_u = P.pore_ratio(step.cast("double") * 20.0, "filled")
        return P.zone_fos("zone_kind", P.bench_fos("cohesion", "phi", "gamma", "height", "theta", r_u, retention), P.floor_fos("pore_kpa", "filled"))

    grid = F.transform(F.sequence(F.lit(0), F.lit(11)), fos_at)
    s = s.select("slope_id", grid.alias("g"))
    ups = F.exists(F.sequence(F.lit(1), F.lit(11)), lambda i: F.col("g")[i] - F.col("g")[i - 1] > 1e-9)
    return s.select("slope_id", F.round(F.array_min("g"), 4).alias("min_fos"), F.round(F.array_max("g"), 4).alias("max_fos"), (~ups).alias("never_rises"))


@query("ordinal_encoding", f"""WITH {SLOPES} SELECT slope_id, CAST(list_position({ENUMS['crack_severity']}, severity) - 1 AS INTEGER) AS severity_ordinal, CASE WHEN filled THEN 1e0 ELSE 0e0 END AS filled_value FROM slopes""")
def ordinal_encoding(spark, folder):
    return A.slope_attributes(spark, folder).select("slope_id", S.ordinal("severity", "crack_severity").alias("severity_ordinal"),
                                                   F.col("filled").cast("int").cast("double").alias("filled_value"))


_MAT_SQL = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}e0" for v in m) + ")" for m in MATERIALS)
_MAT = f"mat AS (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {_MAT_SQL}) v(material_class, weakness, clay, density_lo, density_hi, cohesion_lo, cohesion_hi, phi_lo, phi_hi, parameter_regime))"
_NAMES = [m[0] for m in MATERIALS]


@query("material_lookup", f"""WITH {_MAT}, p AS (SELECT p_partkey AS slope_id, {_NAMES}[CAST(p_partkey % 9 AS INTEGER) + 1] AS material_class, (p_size - 1) / 49e0 AS u FROM part)
SELECT slope_id, p.material_class, {R('0.5e0 + 0.5e0 * weakness', alias='susceptibility')}, round_even((density_lo + u * (density_hi - density_lo)) * 9.81e0 / 1000e0, 3) AS unit_weight,
 {R('coalesce(cohesion_lo + u * (cohesion_hi - cohesion_lo), 0)', alias='cohesion')}, {R('coalesce(phi_lo + u * (phi_hi - phi_lo), 0)', alias='phi')}, parameter_regime FROM p JOIN mat USING (material_class)""")
def material_lookup(spark, folder):
    """Material properties at a point of their published ranges; absent ranges count as 0."""
    key = F.col("p_partkey")
    part = RD.table(spark, folder, "part").select(
        key.alias("slope_id"), F.array(*[F.lit(n) for n in _NAMES])[(key % 9).cast("int")].alias("material_class"), ((F.col("p_size") - 1) / 49.0).alias("u"))
    j = part.join(materials(spark), "material_class")
    mid = lambda a, b: F.col(a) + F.col("u") * (F.col(b) - F.col(a))
    return j.select("slope_id", "material_class", F.round(P.susceptibility("weakness"), 4).alias("susceptibility"),
                    P.unit_weight(mid("density_lo", "density_hi")).alias("unit_weight"),
                    F.round(F.coalesce(mid("cohesion_lo", "cohesion_hi"), F.lit(0.0)), 4).alias("cohesion"),
                    F.round(F.coalesce(mid("phi_lo", "phi_hi"), F.lit(0.0)), 4).alias("phi"), "parameter_regime")


@query("ppv_attenuation", f"""WITH v AS (SELECT l_suppkey, CASE WHEN l_quantity > 0 THEN least(858.9e0 * pow((150e0 + l_suppkey % 10 * 50) / sqrt(l_quantity * 10e0), -1.58e0) * (1e0 + l_discount), 100e0) ELSE 0e0 END AS ppv FROM lineitem)
SELECT l_suppkey, count(*) AS n, {R('avg(ppv)', alias='mean_ppv')}, {R('max(ppv)', alias='max_ppv')}, count(*) FILTER (WHERE ppv > 12.5) AS n_above_safe FROM v GROUP BY l_suppkey""")
def ppv_attenuation(spark, folder):
    """Vibration of every charge at its receiver; the law's constants come from the key/value table."""
    const = RD.constants_row(blast_constants(spark), ["K", "b", "safe_level_mms"])
    li = RD.table(spark, folder, "lineitem")
    ppv = P.peak_particle_velocity((150 + F.col("l_suppkey") % 10 * 50).cast("double"), F.col("l_quantity") * 10.0,
                                   const.select("K").scalar(), const.select("b").scalar(), 1.0 + F.col("l_discount"))
    v = li.select("l_suppkey", ppv.alias("ppv"), const.select("safe_level_mms").scalar().alias("safe"))
    return rounded(v.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("ppv").alias("mean_ppv"), F.max("ppv").alias("max_ppv"),
                                              F.count_if(F.col("ppv") > F.col("safe")).alias("n_above_safe")), ["l_suppkey", "n", "n_above_safe"], ["mean_ppv", "max_ppv"])


# ---------------------------------------------------------------- latest states, boards
_LATEST = f"""{PANEL}, latest AS (SELECT zone_id, arg_max(score, day_idx) AS score, arg_max(ppv, day_idx) AS ppv, arg_max(groundwater_proxy, day_idx) AS groundwater_proxy,
 arg_max(crack_density, day_idx) AS crack_density, arg_max(blast_occurs, day_idx) AS blast_occurs FROM panel GROUP BY zone_id),
z AS (SELECT *, {band('score')} AS band FROM latest)"""


def latest_zones(spark, folder):
    p = A.events_panel(spark, folder).select("seed", "zone_id", "day_idx", "score", "ppv", "groundwater_proxy", "crack_density", "blast_occurs")
    return RD.latest_states(p).withColumn("band", S.score_band("score"))


_DEC = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in d) + ")"
                 for d in [*DECISIONS, *[(b, *r[1:]) for b in ("Very Low", "Low") for r in DECISIONS if r[0] == "Moderate"]])
_DECT = f"dec AS (SELECT * FROM (VALUES {_DEC}) v(band, pos, role, message, action, priority))"


@query("decisions_by_band", f"""WITH {_LATEST}, {_DECT} SELECT zone_id, z.band, role, replace(message, '{{zone}}', 'Zone ' || zone_id) AS message, action, priority,
 CASE priority WHEN 'immediate' THEN 'Immediate Action' WHEN 'high' THEN 'High Priority' WHEN 'standby' THEN 'Standby' ELSE 'Operational' END AS urgency FROM z JOIN dec USING (band)""")
def decisions_by_band(spark, folder):
    z = latest_zones(spark, folder).withColumn("zone_name", F.concat(F.lit("Zone "), F.col("zone_id").cast("string")))
    return B.decisions_by_band(z).select("zone_id", "band", "role", "message", "action", "priority", "urgency")


@query("risk_board", f"""WITH {_LATEST} SELECT count(*) FILTER (WHERE band = 'Critical') AS n_critical, count(*) FILTER (WHERE band = 'High') AS n_high, count(*) FILTER (WHERE band = 'Moderate') AS n_moderate,
 count(*) FILTER (WHERE band IN ('Low', 'Very Low')) AS n_low, count(*) AS n_zones, CAST(floor(avg(floor(score / 100e0 * 100e0 + 0.5)) + 0.5) AS BIGINT) AS confidence_pct,
 CAST(coalesce(sum(zone_id % 5) FILTER (WHERE band IN ('High', 'Critical')), 0) AS BIGINT) AS people_in_hazard,
 CASE WHEN count(*) FILTER (WHERE band = 'Critical') > 0 THEN 'CRITICAL_ALERT' WHEN count(*) FILTER (WHERE band = 'High') > 0 THEN 'HIGH_ALERT' ELSE 'NORMAL_OPERATIONS' END AS status FROM z""")
def risk_board(spark, folder):
    z = latest_zones(spark, folder).withColumns({"confidence": F.col("score") / 100.0, "people": F.col("zone_id") % 5})
    return B.risk_board(z, "people")


@query("risk_board_members", f"WITH {_LATEST} SELECT replace(upper(band), ' ', '_') AS band, zone_id FROM z")
def risk_board_members(spark, folder):
    return B.band_members(latest_zones(spark, folder))


_ALERT = f"""{_LATEST}, {_DECT}, al AS (SELECT 'zone-' || zone_id || '-' || lower(z.band) AS alert_id, zone_id, z.band || ' risk detected in Zone ' || zone_id AS title,
 replace(message, '{{zone}}', 'Zone ' || zone_id) AS summary, upper(z.band) AS severity, action FROM z JOIN dec USING (band) WHERE pos = 0 AND z.band IN ('High', 'Critical'))"""


@query("zone_alerts", f"WITH {_ALERT} SELECT * FROM al")
def zone_alerts(spark, folder):
    return B.alerts(latest_zones(spark, folder))


@query("open_alerts", f"WITH {_ALERT} SELECT severity, count(*) AS n_open FROM al WHERE zone_id % 2 = 1 GROUP BY severity")
def open_alerts(spark, folder):
    """Alerts left after acknowledgements (here: those of even zones)."""
    al = B.alerts(latest_zones(spark, folder))
    return B.open_alerts(al, al.where("zone_id % 2 = 0")).groupBy("severity").agg(F.count(F.lit(1)).alias("n_open"))


@query("missing_evidence", f"""WITH {_LATEST} SELECT zone_id, CASE WHEN blast_occurs THEN '' ELSE 'ppv|' END || CASE WHEN groundwater_proxy > 20 THEN '' ELSE 'groundwater_proxy|' END || '{"|".join(PROVENANCE_GAPS)}' AS gaps,
 CAST(3 + CASE WHEN blast_occurs THEN 0 ELSE 1 END + CASE WHEN groundwater_proxy > 20 THEN 0 ELSE 1 END AS INTEGER) AS n_gaps FROM z""")
def missing_evidence(spark, folder):
    z = latest_zones(spark, folder).withColumns({"ppv": F.when(F.col("blast_occurs"), F.col("ppv")),
                                                "groundwater_proxy": F.when(F.col("groundwater_proxy") > 20, F.col("groundwater_proxy"))})
    gaps = B.missing_evidence(["ppv", "groundwater_proxy", "crack_density"])
    return z.select("zone_id", F.array_join(gaps, "|").alias("gaps"), F.size(gaps).alias("n_gaps"))


def override_requests(z):
    """Requests derived from the zones: raise vibration, set the proxy, or name an unknown field."""
    value = F.create_map
    ov = (F.when(F.col("zone_id") % 3 == 0, value(F.lit("ppv"), F.col("ppv") * 1.5 + 10.0))
          .when(F.col("zone_id") % 3 == 1, value(F.lit("groundwater_proxy"), F.lit(150.0)))
          .otherwise(value(F.lit("crack_density"), F.lit(2.0), F.lit("slope_colour"), F.lit(1.0))))
    return z.select("zone_id", ov.alias("overrides"))


@query("overrides_delta", f"""WITH {_LATEST}, o AS (SELECT zone_id, score, least(100e0, 0.6e0 * CASE WHEN zone_id % 3 = 1 THEN 150e0 ELSE groundwater_proxy END + 15e0 * crack_density
 + 0.6e0 * CASE WHEN zone_id % 3 = 0 THEN ppv * 1.5e0 + 10e0 ELSE ppv END) AS simulated FROM z WHERE zone_id % 3 <> 2 AND zone_id % 7 <> 3)
SELECT zone_id, {R('score', alias='baseline')}, {R('simulated')}, {R('simulated - score', alias='delta')}, {band('score')} AS baseline_band, {band('simulated')} AS simulated_band FROM o""")
def overrides_delta(spark, folder):
    """Counterfactual scores of overridden zones, outside the excluded failure mode."""
    z, _ = B.in_scope(latest_zones(spark, folder), F.col("zone_id") % 7 == 3, "uplift")
    merged, _ = B.apply_overrides(z.withColumnRenamed("score", "baseline").drop("band"), override_requests(z), "zone_id", ["ppv", "groundwater_proxy", "crack_density"])
    sim = merged.withColumn("simulated", A.demo_score("groundwater_proxy", "crack_density", "ppv"))
    return sim.select("zone_id", F.round("baseline", 4).alias("baseline"), F.round("simulated", 4).alias("simulated"),
                      F.round(F.col("simulated") - F.col("baseline"), 4).alias("delta"), S.score_band("baseline").alias("baseline_band"),
                      S.score_band("simulated").alias("simulated_band"))


@query("override_rejects", """SELECT DISTINCT user_id AS zone_id, 'slope_colour' AS unknown FROM events WHERE user_id % 3 = 2""")
def override_rejects(spark, folder):
    z = latest_zones(spark, folder)
    _, rejected = B.apply_overrides(z, override_requests(z), "zone_id", ["ppv", "groundwater_proxy", "crack_density"])
    return rejected.select("zone_id", F.array_join("unknown", ",").alias("unknown"))


@query("scope_guard", """SELECT DISTINCT user_id AS zone_id, 'counterfactual not valid for uplift failure' AS reason FROM events WHERE user_id % 7 = 3""")
def scope_guard(spark, folder):
    _, out = B.in_scope(latest_zones(spark, folder), F.col("zone_id") % 7 == 3, "counterfactual not valid for uplift failure")
    return out.select("zone_id", "reason")


@query("zone_board", f"""WITH {_LATEST} SELECT zone_id, ['ZONE_A','ZONE_B','ZONE_C','ZONE_D'][CAST(zone_id % 4 AS INTEGER) + 1] AS zone_code, ['A','B','C','D'][CAST(zone_id % 4 AS INTEGER) + 1] AS zone_letter,
 replace(upper(band), ' ', '_') AS band, CASE band WHEN 'Critical' THEN 'Critical - active monitoring' WHEN 'High' THEN 'Elevated risk' ELSE 'Normal Operations' END AS status,
 [20.51e0, 20.54e0, 20.56e0, 20.58e0][CAST(zone_id % 4 AS INTEGER) + 1] AS lat, CAST(floor(score + 0.5) AS BIGINT) AS confidence_pct FROM z""")
def zone_board(spark, folder):
    """Latest scores with static geometry, display bands, status and key suffix."""
    code = F.array(*[F.lit(c) for c in ("ZONE_A", "ZONE_B", "ZONE_C", "ZONE_D")])[(F.col("zone_id") % 4).cast("int")]
    z = latest_zones(spark, folder).withColumn("zone_code", code)
    geo = zones(spark).select(F.col("zone_id").alias("zone_code"), "lat", "lng")
    return B.attach_geometry(z, geo, "zone_code").select("zone_id", "zone_code", S.key_suffix("zone_code").alias("zone_letter"), "band", "status", "lat",
                                                         S.confidence_pct(F.col("score") / 100.0).alias("confidence_pct"))


@query("nearest_zone", f"""WITH p AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lng, CAST(label AS BIGINT) AS label FROM embeddings),
 c AS (SELECT label AS zone_id, avg(lat) AS zlat, avg(lng) AS zlng FROM p GROUP BY label), d AS (SELECT point_id, zone_id, sqrt((lat - zlat) * (lat - zlat) + (lng - zlng) * (lng - zlng)) AS dist FROM p, c)
SELECT point_id, zone_id, {R('dist', 6)} FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d.dist, zone_id) = 1""")
def nearest_zone_query(spark, folder):
    pts = A.points(spark, folder).drop("label")
    return rounded(nearest_zone(pts, A.label_centres(spark, folder)), ["point_id", "zone_id"], ["dist"], 6)


@query("nearest_zone_many", f"""WITH z AS (SELECT p_partkey AS zone_id, (p_partkey % 200) * 1e0 AS zlat, CAST(p_size AS DOUBLE) AS zlng FROM part),
 p AS (SELECT l_orderkey, l_linenumber, l_extendedprice % 200e0 AS lat, CAST(l_quantity AS DOUBLE) AS lng FROM lineitem),
 u AS (SELECT DISTINCT lat, lng FROM p), b AS (SELECT lat, lng, min({{'d': sqrt(pow(lat - zlat, 2) + pow(lng - zlng, 2)), 'z': zone_id}}) AS m FROM u, z GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, m.z AS zone_id, {R('m.d', 6, 'dist')} FROM p JOIN b USING (lat, lng)""")
def nearest_zone_many(spark, folder):
    """Every order line against a zone table of all parts: price and quantity as positions."""
    zones_of = RD.table(spark, folder, "part").select(F.col("p_partkey").alias("zone_id"), (F.col("p_partkey") % 200).cast("double").alias("lat"), F.col("p_size").cast("double").alias("lng"))
    lines = RD.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") % 200.0).alias("lat"), F.col("l_quantity").cast("double").alias("lng"))
    return rounded(nearest_zone(lines, zones_of), ["l_orderkey", "l_linenumber", "zone_id"], ["dist"], 6)


@query("missing_risk_check", """SELECT DISTINCT l_suppkey AS s_suppkey, 'no risk for exposed zone' AS reason FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 4)""")
def missing_risk_check(spark, folder):
    used = RD.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    risks = RD.table(spark, folder, "supplier").where("s_suppkey % 10 <> 4")
    return missing_keys(used, risks, "s_suppkey", "no risk for exposed zone")


@query("display_strings", f"""WITH d AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1)
SELECT event_type, upper(event_type[1]) || lower(event_type[2:]) AS title, upper(regexp_replace('very ' || event_type || ' x', ' ', '_')) AS upper_key, CAST(floor(CASE WHEN m / 1000 <= 1 THEN m / 1000 * 100 ELSE m / 1000 END + 0.5) AS BIGINT) AS pct, n FROM d""")
def display_strings(spark, folder):
    """Display helpers over event kinds: capitalised, first blank replaced, percentages."""
    d = RD.table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return d.select("event_type", S.capitalise("event_type").alias("title"), S.band_upper(F.concat(F.lit("very "), "event_type", F.lit(" x"))).alias("upper_key"),
                    S.confidence_pct(F.col("m") / 1000.0).alias("pct"), "n")


@query("live_join_measured", """SELECT l_returnflag, count(*) AS n, count(s_suppkey) AS n_known, round(sum(s_acctbal), 2) AS sum_balance FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def live_join_measured(spark, folder):
    """Readings with their unit's attributes; the dimension is broadcast only when it measures small."""
    s = RD.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").alias("known"), "s_acctbal")
    j = lookup(RD.table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag"), s, "l_suppkey", "left")
    return j.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_known"), F.round(F.sum("s_acctbal"), 2).alias("sum_balance"))
