"""Rule families of the panel contract on inputs with broken rows, and reports of requests that can't be served.

The inputs are the benchmark tables with columns derived by one SQL text for both engines; each family has rows that break it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgauge.operators import quality as Q
from pitgauge.operators import routing as RT
from pitgauge.operators import setops as SO
from pitgauge.operators.panel import column_presence
from pitgauge.plans.quality_plans import _union
from pitgauge.plans.registry import query
from pitgauge.plans.sql import DENSE, PANEL, label
from pitgauge.schemas import ENUMS
from pitgauge.sources import adapters as A
from pitgauge.sources import readers as RD
from pitgauge.functions import scoring as S

CONTRACT_ENUMS = ("rainfall_regime", "groundwater_state", "crack_family", "crack_severity", "slope_condition", "risk_label")


def _pick(values: list[str], number: str, spoiled: str) -> str:
    """CASE text: the value at a number, or a value outside the enumeration where ``spoiled`` holds."""
    whens = " ".join(f"WHEN {number} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE WHEN {spoiled} THEN 'other' {whens} END"


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in columns.items()]


_CONTRACT = {"seed": "nullif(l_suppkey % 10, 7)", "zone_id": "l_partkey", "day_idx": "nullif(l_linenumber, 6)",
             **{c: _pick(ENUMS[c], "l_orderkey", f"l_partkey % 31 = {i}") for i, c in enumerate(CONTRACT_ENUMS)}}


@query("contract_checks", f"WITH src AS (SELECT {', '.join(_select(_CONTRACT))} FROM lineitem), " + _union(
    [(f"not_null_{c}", "error", "true", f"{c} IS NOT NULL") for c in ("seed", "zone_id", "day_idx")] + [(f"enum_{c}", "error", "true", _in(c, ENUMS[c])) for c in CONTRACT_ENUMS]))
def contract_checks(spark, folder):
    """Keys present and enumerations respected; some keys are null and some values unknown."""
    return Q.check_rows(RD.table(spark, folder, "lineitem").selectExpr(*_select(_CONTRACT)), Q.contract_rules())


_EXPECTED = ["l_orderkey", "l_partkey", "l_batch", "l_quantity", "l_inspector"]


@query("contract_columns", f"""WITH want AS (SELECT unnest({_EXPECTED}) AS column_name), long AS (
 UNPIVOT (SELECT count(l_orderkey) AS l_orderkey, count(l_partkey) AS l_partkey, count(l_suppkey) AS l_suppkey, count(l_linenumber) AS l_linenumber, count(l_quantity) AS l_quantity,
  count(l_extendedprice) AS l_extendedprice, count(l_discount) AS l_discount, count(l_tax) AS l_tax, count(l_returnflag) AS l_returnflag, count(l_linestatus) AS l_linestatus, count(l_shipdate) AS l_shipdate FROM lineitem)
 ON COLUMNS(*) INTO NAME column_name VALUE n_values)
SELECT coalesce(w.column_name, h.column_name) AS column_name, CASE WHEN h.column_name IS NULL THEN 'missing' WHEN w.column_name IS NULL THEN 'unexpected' ELSE 'present' END AS status, coalesce(n_values, 0) AS n_values
FROM want w FULL JOIN long h ON w.column_name = h.column_name""")
def contract_columns(spark, folder):
    """Columns that a contract expects and the table doesn't have, and the reverse, with how many values each holds."""
    return column_presence(RD.table(spark, folder, "lineitem"), _EXPECTED)


_REQUEST = {"rainfall_24h_mm": "p_size - 2", "rainfall_7d_mm": "p_size * 2", "slope_angle_deg": "p_size - 1", "slope_height_m": "p_size * 1", "crack_density": "p_size / 18e0", "blast_frequency_per_week": "p_size - 3",
            "days_since_inspection": "p_partkey % 40 - 1", "groundwater_proxy": "p_retailprice", "crack_severity": _pick(ENUMS["crack_severity"], "p_partkey", "p_size = 9"),
            "rock_type": _pick(ENUMS["material_class"], "p_partkey", "p_size = 11")}
_NON_NEGATIVE = [c for c in _REQUEST if c not in ("crack_severity", "rock_type")]
_NON_NEGATIVE.remove("groundwater_proxy")
_REQUEST_SQL = [(f"non_negative_{c}", "error", "true", f"{c} >= 0") for c in (*_NON_NEGATIVE, "groundwater_proxy")] + [
    ("density_limit", "error", "true", "crack_density <= 2.5"), ("proxy_limit", "error", "true", "groundwater_proxy <= 1000"),
    ("severity_enum", "error", "true", _in("crack_severity", ENUMS["crack_severity"])), ("rock_enum", "error", "true", _in("rock_type", ENUMS["material_class"]))]


@query("request_checks", f"WITH src AS (SELECT {', '.join(_select(_REQUEST))} FROM part), {_union(_REQUEST_SQL)}")
def request_checks(spark, folder):
    """Bounds and enumerations of scoring requests, one request per part; several are out of bounds."""
    return Q.check_rows(RD.table(spark, folder, "part").selectExpr(*_select(_REQUEST)), Q.request_rules())


_SITE = {"bench_height_m": "p_size * 1e0", "height_lo": "2e0", "height_hi": "45e0", "bench_face_angle_deg": "p_size + 30e0", "angle_lo": "35e0", "angle_hi": "78e0",
         "cohesion_kpa": "p_partkey % 50 * 1e0", "cohesion_lo": "CASE WHEN p_size % 5 > 0 THEN 3e0 END", "cohesion_hi": "47e0", "friction_angle_deg": "p_partkey % 40 * 1e0", "phi_lo": "CASE WHEN p_size % 7 > 0 THEN 2e0 END", "phi_hi": "38e0",
         "parameter_regime": "CASE WHEN p_size % 2 = 0 THEN 'total_undrained' ELSE 'effective_stress' END", "material_regime": "CASE WHEN p_size % 2 = 0 AND p_size <> 8 THEN 'total_undrained' ELSE 'effective_stress' END",
         "blastable": "p_size % 3 > 0", "blast_occurs": "p_partkey % 4 = 0", "ppv": "CASE WHEN p_partkey % 4 = 0 OR p_partkey % 29 = 0 THEN p_size * 3e0 ELSE 0e0 END", "charge_kg": "p_size * 14e0"}
_SITE_SQL = [
    ("height_in_range", "error", "true", "bench_height_m BETWEEN height_lo - 1e-9 AND height_hi + 1e-9"), ("angle_in_range", "error", "true", "bench_face_angle_deg BETWEEN angle_lo - 1e-9 AND angle_hi + 1e-9"),
    ("cohesion_kpa_in_range", "error", "cohesion_lo IS NOT NULL", "cohesion_kpa BETWEEN cohesion_lo - 0.01 AND cohesion_hi + 0.01"),
    ("friction_angle_deg_in_range", "error", "phi_lo IS NOT NULL", "friction_angle_deg BETWEEN phi_lo - 0.01 AND phi_hi + 0.01"), ("regime_matches", "error", "true", "parameter_regime = material_regime"),
    ("blast_only_where_allowed", "error", "true", "blastable OR NOT blast_occurs"), ("ppv_iff_event", "error", "true", "(ppv > 0) = blast_occurs"), ("ppv_limit", "error", "true", "ppv BETWEEN 0 AND 100"),
    ("charge_range", "error", "blast_occurs", "charge_kg BETWEEN 100 AND 600")]


@query("site_checks", f"WITH src AS (SELECT {', '.join(_select(_SITE))} FROM part), {_union(_SITE_SQL)}")
def site_checks(spark, folder):
    """Terrain, geology and blasting rules (with the charge) on one slope per part; each is broken by some."""
    rows = RD.table(spark, folder, "part").selectExpr(*_select(_SITE))
    return Q.check_rows(rows, Q.terrain_rules() + Q.geology_rules() + Q.blast_rules(charge="charge_kg"))


_STABLE = {"fos": "CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE l_quantity / 20e0 END", "fos_dry": "l_quantity / 20e0 + 0.3e0", "fos_wet": "l_quantity / 20e0 + CASE WHEN l_partkey % 17 = 0 THEN 0.4e0 ELSE 0.2e0 END",
           "fos_cracked": "l_quantity / 20e0 + CASE WHEN l_partkey % 23 = 0 THEN 0.25e0 ELSE 0.1e0 END", "fos_blast": "l_quantity / 20e0 + CASE WHEN l_partkey % 13 = 0 THEN 0.15e0 ELSE 0e0 END", "spoiled": "l_partkey % 19 = 0"}
_SCORE = "CASE WHEN fos IS NOT NULL THEN round_even(least(100e0, greatest(0e0, 100e0 * (2.5e0 - fos) / 2e0)), 1) END"
_STABLE_SQL = f"""base AS (SELECT {', '.join(_select(_STABLE))} FROM lineitem),
src AS (SELECT *, CASE WHEN spoiled THEN 'low' ELSE {label('fos')} END AS risk_label,
 {_SCORE} + CASE WHEN spoiled THEN 60e0 ELSE 0e0 END AS instability_score FROM base)"""
_STABLE_RULES = [
    ("fos_defined", "error", "true", "fos >= 0"), ("label_follows_fos", "error", "true", f"risk_label = {label('fos')}"),
    ("score_follows_fos", "error", "true", f"abs(instability_score - {_SCORE}) <= 0.051"), ("score_bounds", "error", "true", "instability_score BETWEEN 0 AND 100"),
    ("wet_not_above_dry", "error", "true", "fos_wet <= fos_dry + 1e-9"), ("cracked_not_above_wet", "error", "true", "fos_cracked <= fos_wet + 1e-9"), ("blast_not_above_cracked", "error", "true", "fos_blast <= fos_cracked + 1e-9")]


@query("stability_checks", f"WITH {_STABLE_SQL}, {_union(_STABLE_RULES)}")
def stability_checks(spark, folder):
    """Labels and scores as functions of stability, and the order of the states; every rule is broken by some lines."""
    from pitgauge.functions import physics as P

    rows = RD.table(spark, folder, "lineitem").selectExpr(*_select(_STABLE))
    rows = rows.withColumn("risk_label", F.when(F.col("spoiled"), "low").otherwise(P.risk_label("fos"))).withColumn("instability_score", P.instability_score("fos") + F.when(F.col("spoiled"), 60.0).otherwise(0.0))
    return Q.check_rows(rows, Q.stability_rules() + Q.ordering_rules())


@query("sparse_completeness", """WITH d AS (SELECT user_id % 5 AS seed, user_id AS zone_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day_idx FROM events GROUP BY ALL)
SELECT seed, zone_id, count(*) AS n_rows, count(DISTINCT day_idx) AS n_days, max(day_idx) AS last_day FROM d GROUP BY 1, 2 HAVING count(*) <> (SELECT max(day_idx) + 1 FROM d)""")
def sparse_completeness(spark, folder):
    """Series of the readings as they came, before any gap is filled, that miss days."""
    days = A.events_daily(RD.table(spark, folder, "events")).select("seed", "zone_id", F.date_diff("day", F.lit(A.PANEL_START)).alias("day_idx"))
    return Q.completeness(days)


@query("other_seed_differs", f"""WITH {PANEL}, a AS (SELECT seed, zone_id, day_idx, wet_day FROM panel), b AS (SELECT (seed + 1) % 5 AS seed, zone_id, day_idx, wet_day FROM panel),
 n AS (SELECT seed, zone_id, day_idx, wet_day FROM (SELECT *, 1 AS l FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL HAVING sum(l) <> 0)
SELECT count(*) AS n_different, count(*) = 0 AS is_equal FROM n""")
def other_seed_differs(spark, folder):
    """The panel against the one in which every world has the next one's rows: they must differ."""
    a = A.events_dense(spark, folder).select("seed", "zone_id", "day_idx", "wet_day")
    return SO.equality_report(a, a.withColumn("seed", (F.col("seed") + 1) % 5))


@query("tolerance_beyond", f"""WITH {DENSE}, g AS (SELECT abs(CASE WHEN day_idx % 7 = 0 THEN 0.5e0 ELSE 0e0 END) AS gap, day_idx % 11 = 3 AS lost FROM dense)
SELECT count(*) FILTER (WHERE lost) AS n_unmatched, max(gap) FILTER (WHERE NOT lost) AS max_gap, count(*) FILTER (WHERE NOT lost AND gap > 0.1) AS n_beyond FROM g""")
def tolerance_beyond(spark, folder):
    """A panel against itself with days lost and others off by a half."""
    d = A.events_dense(spark, folder).select("seed", "zone_id", "day_idx", F.col("day_idx").cast("double").alias("m"))
    other = d.where("day_idx % 11 <> 3").withColumn("m", F.col("m") + F.when(F.col("day_idx") % 7 == 0, 0.5).otherwise(0.0))
    return SO.tolerance_report(d, other, ["seed", "zone_id", "day_idx"], ["m"], 0.1)


@query("unreachable_requests", """WITH m AS (SELECT max(s_suppkey) AS top FROM supplier), rq AS (SELECT s_suppkey AS src, s_suppkey + s_nationkey AS dst FROM supplier)
SELECT src, dst, CASE WHEN dst > top THEN 'unknown endpoint' ELSE 'no route' END AS reason FROM rq, m WHERE dst > top OR (src - dst) % 5 <> 0""")
def unreachable_requests(spark, folder):
    """Requests that no route answers: zones past the last one, and zones of another of five separate road chains."""
    sup = RD.table(spark, folder, "supplier")
    nodes = sup.select(F.col("s_suppkey").alias("node"))
    roads = sup.select(F.col("s_suppkey").alias("road_id"), F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 5).alias("dst"), F.lit(1.0).alias("length")).withColumn("adjacent", F.lit(None).cast("array<string>"))
    requests = sup.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + F.col("s_nationkey")).alias("dst"))
    edges = RT.with_worst_risk(RT.build_edges(nodes, roads), nodes.withColumn("risk", F.lit(0.0)))
    return RT.unreachable(requests, nodes, RT.cheapest_paths(edges, requests, {"length": S._c("length")}))
