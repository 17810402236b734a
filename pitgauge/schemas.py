"""Table schemas, enumerations and the small fixed dimensions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ordered enumerations of the panel contract.
ENUMS: dict[str, list[str]] = {
    "rainfall_regime": ["dry", "normal", "wet", "storm"],
    "groundwater_state": ["dry", "normal", "elevated", "high", "critical"],
    "crack_family": ["none", "tension_crest", "desiccation", "blast_induced", "seepage", "floor_heave"],
    "crack_severity": ["normal", "minor", "moderate", "severe", "critical"],
    "slope_condition": ["stable", "marginal", "unstable", "failed"],
    "risk_label": ["very_low", "low", "moderate", "high", "critical"],
    "parameter_regime": ["total_undrained", "effective_stress"],
    "material_class": [
        "lateritic_soil", "clayey_sandstone", "sandstone", "clay", "variegated_sandy_clay",
        "carbonaceous_clay", "aquifer_sand", "lignite", "overburden_mixed",
    ],
    "scenario_kind": ["none", "rainfall_storm", "prolonged_rain", "historical_rain", "combined", "blast_surge"],
}
BANDS = ["Very Low", "Low", "Moderate", "High", "Critical"]

_D, _S, _B, _I, _L = T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()

# The internal (world, zone, day) panel; day_idx replaces implicit row order.
STATE_SCHEMA = T.StructType(
    [T.StructField("seed", _L, False), T.StructField("zone_id", _S, False),
     T.StructField("timestamp", T.DateType(), False), T.StructField("day_idx", _I, False)]
    + [T.StructField(n, t) for n, t in [
        ("rainfall_mm", _D), ("rainfall_3d_mm", _D), ("rainfall_7d_mm", _D), ("wet_day", _B),
        ("rainfall_regime", _S), ("elevation_m", _D), ("regional_slope_deg", _D), ("bench_height_m", _D),
        ("bench_face_angle_deg", _D), ("distance_to_crest_m", _D), ("slope_angle_deg", _D),
        ("slope_height_m", _D), ("material_class", _S), ("cohesion_kpa", _D), ("friction_angle_deg", _D),
        ("unit_weight_kn_m3", _D), ("parameter_regime", _S), ("groundwater_state", _S),
        ("pore_pressure_kpa", _D), ("groundwater_thrust_kpa", _D), ("blast_occurs", _B),
        ("blast_frequency_per_week", _D), ("charge_per_delay_kg", _D), ("blast_distance_m", _D),
        ("dominant_frequency_hz", _D), ("blast_vibration_ppv_mms", _D), ("crack_family", _S),
        ("crack_width_mm", _D), ("crack_depth_m", _D), ("crack_length_m", _D), ("crack_density", _D),
        ("water_filled", _B), ("crack_growth_rate_mm_day", _D), ("crack_severity", _S),
        ("days_since_inspection", _I), ("prior_incident", _B), ("groundwater_proxy", _D), ("fos", _D),
        ("slope_condition", _S), ("instability_score", _D), ("risk_label", _S), ("synthetic", _B)]]
)

# ML-facing name <- internal name.
ML_PROJECTION = {
    "rainfall_24h_mm": "rainfall_mm",
    "rainfall_7d_mm": "rainfall_7d_mm",
    "slope_angle_deg": "slope_angle_deg",
    "slope_height_m": "slope_height_m",
    "rock_type": "material_class",
    "crack_density": "crack_density",
    "crack_severity": "crack_severity",
    "blast_frequency_per_week": "blast_frequency_per_week",
    "blast_vibration_ppv_mms": "blast_vibration_ppv_mms",
    "days_since_inspection": "days_since_inspection",
    "prior_incident": "prior_incident",
    "groundwater_proxy": "groundwater_proxy",
}
ML_TARGETS = ["fos", "instability_score", "risk_label"]

DAILY_SERIES_SCHEMA = T.StructType(
    [T.StructField("station_id", _S), T.StructField("day", T.DateType()), T.StructField("value", _D)])
GRID_SCHEMA = T.StructType(
    [T.StructField("day", T.DateType()), T.StructField("lat", _D), T.StructField("lon", _D),
     T.StructField("value", _D)])
RASTER_SCHEMA = T.StructType(
    [T.StructField("tile", _S), T.StructField("row", _L), T.StructField("col", _L), T.StructField("elev", _D)])
EVENTS_SCHEMA = T.StructType(
    [T.StructField("event_id", _L), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", _L),
     T.StructField("event_type", _S), T.StructField("value", _D), T.StructField("props", _S)])
_N = T.TimestampNTZType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# The benchmark tables that queries read; declared, so opening one costs no job.
TABLE_SCHEMAS = {
    "events": EVENTS_SCHEMA,
    "orders": _struct(o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_N, o_orderpriority=_S),
    "lineitem": _struct(l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D, l_extendedprice=_D, l_discount=_D,
                        l_tax=_D, l_returnflag=_S, l_linestatus=_S, l_shipdate=_N),
    "part": _struct(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "supplier": _struct(s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    "embeddings": _struct(vec_id=_L, embedding=T.ArrayType(T.FloatType()), label=_I),
    "documents": _struct(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "labels": _struct(doc_id=_L, quality=_I, toxic=_I),
}
SCENARIO_SCHEMA = T.StructType(
    [T.StructField("scenario_id", _S), T.StructField("kind", _S), T.StructField("zone_id", _S),
     T.StructField("start_day", _I), T.StructField("duration_days", _I),
     T.StructField("params", T.MapType(_S, _D)), T.StructField("template_id", _S)])

# Zones (name, kind, height, face angle, crest distance, height range, angle range,
# receiver distance, thrust range, centre latitude and longitude, blastable).
ZONES = [
    ("ZONE_A", "Zone A", "bench", 25.0, 60.0, 10.0, 18.0, 25.0, 45.0, 75.0, 300.0, 20.0, 60.0, 20.51, 80.115, True),
    ("ZONE_B", "Zone B", "bench", 18.0, 55.0, 20.0, 18.0, 25.0, 45.0, 75.0, 150.0, 40.0, 120.0, 20.54, 80.165, True),
    ("ZONE_C", "Zone C", "bench", 6.0, 75.0, 5.0, 6.0, 6.0, 75.0, 75.0, 400.0, 100.0, 300.0, 20.56, 80.115, False),
    ("ZONE_D", "Zone D", "floor", 0.0, 5.0, 0.0, 0.0, 0.0, 0.0, 10.0, 500.0, 490.0, 785.0, 20.58, 80.165, False),
]
ZONE_SCHEMA = (
    "zone_id string, zone_name string, zone_kind string, bench_height_m double, bench_face_angle_deg double, "
    "distance_to_crest_m double, height_lo double, height_hi double, angle_lo double, angle_hi double, "
    "receiver_distance_m double, thrust_lo double, thrust_hi double, lat double, lng double, blastable boolean"
)

# Materials (name, weakness, clay-likeness, density, cohesion and friction ranges, regime).
MATERIALS = [
    ("lateritic_soil", 0.75, 0.4, 1980.0, 2100.0, 588.0, 883.0, 18.0, 30.0, "total_undrained"),
    ("clayey_sandstone", 0.55, 0.45, 2000.0, 2400.0, 29.0, 157.0, 25.0, 40.0, "total_undrained"),
    ("sandstone", 0.35, 0.1, 2000.0, 2400.0, 29.0, 157.0, 25.0, 40.0, "total_undrained"),
    ("clay", 1.0, 1.0, 2000.0, 2300.0, 196.0, 883.0, None, None, "total_undrained"),
    ("variegated_sandy_clay", 0.9, 0.85, 1900.0, 2300.0, 245.0, 981.0, 15.0, 35.0, "total_undrained"),
    ("carbonaceous_clay", 0.95, 0.95, 2000.0, 2300.0, 196.0, 883.0, None, None, "total_undrained"),
    ("aquifer_sand", 0.7, 0.15, 1900.0, 2100.0, 0.0, 0.0, 28.0, 36.0, "literature"),
    ("lignite", 0.3, 0.2, 1300.0, 1450.0, None, None, None, None, "literature"),
    ("overburden_mixed", 0.8, 0.7, 1900.0, 2300.0, 49.0, 196.0, None, None, "total_undrained"),
]
MATERIAL_SCHEMA = (
    "material_class string, weakness double, clay double, density_lo double, density_hi double, "
    "cohesion_lo double, cohesion_hi double, phi_lo double, phi_hi double, parameter_regime string"
)

# Constants of the vibration attenuation law.
BLAST_CONSTANTS = [("K", 858.90, "unitless"), ("b", 1.58, "unitless"), ("safe_level_mms", 12.5, "mm/s")]

# Role actions per band; {zone} is filled with the zone's name.
DECISIONS = [
    ("Critical", 0, "worker", "Avoid {zone}", "safe route guidance", "immediate"),
    ("Critical", 1, "safety_officer", "Prioritize inspection of {zone}", "early risk intervention", "high"),
    ("Critical", 2, "mine_manager", "Coordinate evacuation of {zone}", "operational decision", "high"),
    ("Critical", 3, "rescue_team", "Use safer approach route to {zone}", "risk-aware response", "standby"),
    ("High", 0, "worker", "Restrict entry to this zone", "restricted access", "high"),
    ("High", 1, "safety_officer", "Inspect this zone today", "early risk intervention", "high"),
    ("High", 2, "mine_manager", "Review operations in this zone", "operational decision", "medium"),
    ("High", 3, "rescue_team", "Standby near this zone", "risk-aware response", "standby"),
    ("Moderate", 0, "worker", "Exercise caution in this zone", "awareness", "normal"),
    ("Moderate", 1, "safety_officer", "Schedule an inspection this week", "monitoring", "normal"),
    ("Moderate", 2, "mine_manager", "Monitor this zone's trend", "monitoring", "normal"),
    ("Moderate", 3, "rescue_team", "No action required", "none", "none"),
]

# Evidence that the data plan never supplies in situ.
PROVENANCE_GAPS = [
    "in_situ_vibration_telemetry (PPV is attenuation-modeled)",
    "piezometer_groundwater_sensor (proxy is rainfall-derived)",
    "crack_imagery_cv_feed (severity from inspection sampler)",
]


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as an inlined literal, so that its size is known when a join is planned.

    ``createDataFrame`` over a list has no size estimate and would shuffle the other side.
    """
    names = [field.split()[0] for field in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>")))


def zones(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ZONES, ZONE_SCHEMA)


def materials(spark: SparkSession) -> DataFrame:
    return literal_table(spark, MATERIALS, MATERIAL_SCHEMA)


def blast_constants(spark: SparkSession) -> DataFrame:
    return literal_table(spark, BLAST_CONSTANTS, "key string, value double, unit string")


def decisions(spark: SparkSession) -> DataFrame:
    """Band -> four role actions; bands below Moderate use the Moderate rows."""
    rows = list(DECISIONS)
    rows += [(band, *r[1:]) for band in ("Very Low", "Low") for r in DECISIONS if r[0] == "Moderate"]
    return literal_table(
        spark, rows, "band string, pos int, role string, message string, action string, priority string")


def enum_table(spark: SparkSession) -> DataFrame:
    rows = [(e, v, i) for e, vs in ENUMS.items() for i, v in enumerate(vs)]
    return literal_table(spark, rows, "enum string, value string, ordinal int")
