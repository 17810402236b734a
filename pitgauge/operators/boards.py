"""Decisions, alerts, boards, overrides and evidence lists for scored zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgauge.functions import scoring as S
from pitgauge.schemas import PROVENANCE_GAPS, decisions


def decisions_by_band(zones: DataFrame, name: str = "zone_name") -> DataFrame:
    """Four role actions per zone from its band (a 20-row literal table, broadcast by its size)."""
    acts = decisions(zones.sparkSession)
    return zones.join(acts, "band").withColumns({
        "message": F.replace(F.col("message"), F.lit("{zone}"), F.col(name)), "urgency": S.urgency("priority")})


def risk_board(zones: DataFrame, people: str | None = None) -> DataFrame:
    """Counters of a whole site in one row: zones per band, confidence, exposure, status."""
    b = S.band_upper("band")
    hot = b.isin("HIGH", "CRITICAL")
    exposed = F.sum(F.when(hot, F.col(people)).otherwise(0)) if people else F.lit(0)
    out = zones.agg(
        F.count_if(b == "CRITICAL").alias("n_critical"), F.count_if(b == "HIGH").alias("n_high"),
        F.count_if(b == "MODERATE").alias("n_moderate"), F.count_if(b.isin("LOW", "VERY_LOW")).alias("n_low"),
        F.count(F.lit(1)).alias("n_zones"),
        F.floor(F.coalesce(F.avg(S.confidence_pct("confidence").cast("double")), F.lit(0.0)) + 0.5).cast("long").alias("confidence_pct"),
        F.coalesce(exposed, F.lit(0)).cast("long").alias("people_in_hazard"))
    status = (F.when(F.col("n_critical") > 0, "CRITICAL_ALERT").when(F.col("n_high") > 0, "HIGH_ALERT")
              .otherwise("NORMAL_OPERATIONS"))
    return out.withColumn("status", status)


def band_members(zones: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Zones per band as rows; a list per band would gather an unbounded group."""
    return zones.select(S.band_upper("band").alias("band"), zone)


def alerts(zones: DataFrame, zone: str = "zone_id") -> DataFrame:
    """One alert per High or Critical zone, with the first decision as its summary."""
    first = decisions(zones.sparkSession).where("pos = 0").select("band", "message", "action")
    hot = zones.where(F.col("band").isin("High", "Critical")).join(first, "band", "left")
    zid = F.col(zone).cast("string")
    return hot.select(
        F.concat(F.lit("zone-"), zid, F.lit("-"), F.lower(S.band_upper("band"))).alias("alert_id"), F.col(zone).alias("zone_id"),
        F.concat(S.capitalise("band"), F.lit(" risk detected in Zone "), zid).alias("title"),
        F.replace(F.coalesce("message", F.lit("")), F.lit("{zone}"), F.concat(F.lit("Zone "), zid)).alias("summary"),
        S.band_upper("band").alias("severity"), F.coalesce("action", F.lit("monitor")).alias("action"))


def open_alerts(all_alerts: DataFrame, acknowledged: DataFrame) -> DataFrame:
    return all_alerts.join(acknowledged.select("alert_id").distinct(), "alert_id", "left_anti")


def in_scope(rows: DataFrame, excluded: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows a counterfactual may use, and the rejected rest with the reason."""
    bad = F.coalesce(excluded, F.lit(False))
    return rows.where(~bad), rows.where(bad).withColumn("reason", F.lit(reason))


def missing_evidence(fields: Sequence[str]) -> Column:
    """Names of null fields followed by the evidence that is never measured in situ."""
    nulls = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    return F.concat(nulls, F.array(*[F.lit(g) for g in PROVENANCE_GAPS]))


def unknown_overrides(overrides: Column, fields: Sequence[str]) -> Column:
    return F.array_sort(F.array_except(F.map_keys(overrides), F.array(*[F.lit(f) for f in fields])))


def apply_overrides(base: DataFrame, requests: DataFrame, key: str, fields: Sequence[str],
                    overrides: str = "overrides") -> tuple[DataFrame, DataFrame]:
    """Base rows with each request's values put in, and the requests naming unknown fields."""
    checked = requests.withColumn("unknown", unknown_overrides(F.col(overrides), fields))
    good = base.join(checked.where(F.size("unknown") == 0).drop("unknown"), key)
    merged = good.withColumns({
        f: F.coalesce(F.try_element_at(F.col(overrides), F.lit(f)), F.col(f)) for f in fields})
    return merged, checked.where(F.size("unknown") > 0)


def attach_geometry(live: DataFrame, geometry: DataFrame, on: str) -> DataFrame:
    """Live rows with static zone attributes (a literal dimension, broadcast by its size)."""
    return live.join(geometry, on, "left").withColumns(
        {"status": S.zone_status("band"), "band": S.band_upper("band")})


