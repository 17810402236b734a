"""Data-quality rules: row predicates fused into one scan, group predicates into one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgauge.functions import physics as P
from pitgauge.functions import scoring as S
from pitgauge.schemas import ENUMS
from pitgauge.operators.windows import SERIES, series_window


@dataclass(frozen=True)
class RowRule:
    """Every row must satisfy ``ok`` where ``scope`` holds; an undefined ``ok`` fails."""

    rule_id: str
    ok: Column
    severity: str = "error"
    scope: Column | None = None


@dataclass(frozen=True)
class GroupRule:
    """An aggregate of each group must satisfy ``ok``; ``detail`` is reported."""

    rule_id: str
    ok: Column
    detail: Column
    severity: str = "error"


def _failed(rule: RowRule) -> Column:
    bad = ~F.coalesce(rule.ok, F.lit(False))
    return bad if rule.scope is None else bad & F.coalesce(rule.scope, F.lit(False))


def check_rows(df: DataFrame, rules: Sequence[RowRule], by: Sequence[str] = ()) -> DataFrame:
    """(by..., rule_id, severity, checked_rows, failed_rows, passed) from a single aggregate."""
    sums = df.groupBy(*by).agg(
        *[F.count_if(_failed(r)).alias(f"f{i}") for i, r in enumerate(rules)],
        *[(F.count(F.lit(1)) if r.scope is None else F.count_if(r.scope)).alias(f"n{i}") for i, r in enumerate(rules)])
    return sums.select(*by, F.inline(F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.col(f"n{i}").alias("checked_rows"),
                 F.col(f"f{i}").alias("failed_rows"), (F.col(f"f{i}") == 0).alias("passed")) for i, r in enumerate(rules)])))


def check_groups(df: DataFrame, rules: Sequence[GroupRule], by: Sequence[str] = ()) -> DataFrame:
    """(by..., rule_id, severity, passed, detail) from a single aggregate; undefined fails."""
    sums = df.groupBy(*by).agg(*[c for i, r in enumerate(rules) for c in (
        F.coalesce(r.ok, F.lit(False)).alias(f"p{i}"), r.detail.cast("double").alias(f"d{i}"))])
    return sums.select(*by, F.inline(F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.col(f"p{i}").alias("passed"),
                 F.col(f"d{i}").alias("detail")) for i, r in enumerate(rules)])))


def quarantine(df: DataFrame, rules: Sequence[RowRule]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the rest with the rules they broke."""
    broken = F.array_compact(F.array(*[F.when(_failed(r), F.lit(r.rule_id)) for r in rules]))
    marked = df.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def verdict(results: DataFrame) -> DataFrame:
    """One row: number of rules, failures by severity and the overall result."""
    bad = ~F.col("passed")
    return results.agg(
        F.count(F.lit(1)).alias("n_results"), F.count_if(bad & (F.col("severity") == "error")).alias("n_errors"),
        F.count_if(bad & (F.col("severity") == "warning")).alias("n_warnings"),
        (F.count_if(bad & (F.col("severity") == "error")) == 0).alias("passed"))


# ---------------------------------------------------------------- rule families for the panel contract
# The limits and field names of the contract in the rules below.
def contract_rules(enums: dict[str, list[str]] | None = None) -> list[RowRule]:
    """Keys present and enumerations respected."""
    enums = enums or {c: ENUMS[c] for c in ("rainfall_regime", "groundwater_state", "crack_family", "crack_severity",
                                             "slope_condition", "risk_label")}
    rules = [RowRule(f"not_null_{c}", F.col(c).isNotNull()) for c in ("seed", "zone_id", "day_idx")]
    return rules + [RowRule(f"enum_{c}", F.col(c).isin(v)) for c, v in enums.items()]


def request_rules() -> list[RowRule]:
    """Bounds of a scoring request."""
    non_negative = ["rainfall_24h_mm", "rainfall_7d_mm", "slope_angle_deg", "slope_height_m", "crack_density",
                    "blast_frequency_per_week", "days_since_inspection", "groundwater_proxy"]
    return [RowRule(f"non_negative_{c}", F.col(c) >= 0) for c in non_negative] + [
        RowRule("density_limit", F.col("crack_density") <= 2.5), RowRule("proxy_limit", F.col("groundwater_proxy") <= 1000),
        RowRule("severity_enum", F.col("crack_severity").isin(ENUMS["crack_severity"])),
        RowRule("rock_enum", F.col("rock_type").isin(ENUMS["material_class"]))]


def rain_rules(day1: str = "rainfall_mm", day3: str = "rainfall_3d_mm", day7: str = "rainfall_7d_mm",
               regime: str = "rainfall_regime", wet: str = "wet_day") -> list[RowRule]:
    slack = 1e-9
    return [
        RowRule("rain_non_negative", F.col(day1) >= 0), RowRule("rain_3d_covers_1d", F.col(day3) >= F.col(day1) - slack),
        RowRule("rain_7d_covers_3d", F.col(day7) >= F.col(day3) - slack),
        RowRule("rain_regime_matches", F.col(regime) == P.rain_regime(day1)), RowRule("wet_day_matches", F.col(wet) == (F.col(day1) > 0))]


def terrain_rules() -> list[RowRule]:
    """Bench height and face angle inside the zone's configured ranges (columns joined from the zones)."""
    slack = 1e-9
    return [RowRule("height_in_range", F.col("bench_height_m").between(F.col("height_lo") - slack, F.col("height_hi") + slack)),
            RowRule("angle_in_range", F.col("bench_face_angle_deg").between(F.col("angle_lo") - slack, F.col("angle_hi") + slack))]


def geology_rules() -> list[RowRule]:
    """Cohesion, friction and regime inside the material's ranges; an absent range is not checked."""
    def inside(x, lo, hi):
        return RowRule(f"{x}_in_range", F.col(x).between(F.col(lo) - 0.01, F.col(hi) + 0.01), scope=F.col(lo).isNotNull())
    return [inside("cohesion_kpa", "cohesion_lo", "cohesion_hi"), inside("friction_angle_deg", "phi_lo", "phi_hi"),
            RowRule("regime_matches", F.col("parameter_regime") == F.col("material_regime"))]


def blast_rules(ppv: str = "ppv", occurs: str = "blast_occurs", blastable: str = "blastable", charge: str | None = None) -> list[RowRule]:
    rules = [RowRule("blast_only_where_allowed", F.col(blastable) | ~F.col(occurs)),
             RowRule("ppv_iff_event", (F.col(ppv) > 0) == F.col(occurs)), RowRule("ppv_limit", F.col(ppv).between(0, 100))]
    if charge:
        rules.append(RowRule("charge_range", F.col(charge).between(100, 600), scope=F.col(occurs)))
    return rules


def crack_rules(growth: str = "growth_mm", density: str = "density", depth: str = "depth_m", width: str = "width_mm",
                cap: str = "cap", family: str = "crack_family", floor: Column | None = None) -> list[RowRule]:
    floor = F.col("kind") == "floor" if floor is None else floor
    return [
        RowRule("growth_non_negative", F.col(growth) >= 0), RowRule("growth_below_failure_window", F.col(growth) < 20, "warning"),
        RowRule("depth_within_cap", F.col(depth) <= F.col(cap) + 1e-9),
        RowRule("width_within_cap", F.col(width) <= F.when(floor, 60.0).otherwise(150.0) + 1e-9),
        RowRule("density_bounds", F.col(density).between(0.05, 2.5)), RowRule("depth_implies_width", F.col(width) > 0, scope=F.col(depth) > 0),
        RowRule("floor_family", F.col(family).isin("none", "floor_heave"), scope=floor),
        RowRule("bench_family", F.col(family) != "floor_heave", scope=~floor)]


def stability_rules(fos: str = "fos", label: str = "risk_label", score: str = "instability_score") -> list[RowRule]:
    return [RowRule("fos_defined", F.col(fos).isNotNull() & ~F.isnan(fos) & (F.col(fos) >= 0)),
            RowRule("label_follows_fos", F.col(label) == P.risk_label(fos)),
            RowRule("score_follows_fos", F.abs(F.col(score) - P.instability_score(fos)) <= 0.051),
            RowRule("score_bounds", F.col(score).between(0, 100))]


def ordering_rules(dry: str = "fos_dry", wet: str = "fos_wet", cracked: str = "fos_cracked", blast: str = "fos_blast") -> list[RowRule]:
    """Water, cracks and blasting never add stability."""
    steps = [("wet_not_above_dry", wet, dry), ("cracked_not_above_wet", cracked, wet), ("blast_not_above_cracked", blast, cracked)]
    return [RowRule(name, F.col(low) <= F.col(high) + 1e-9) for name, low, high in steps]


def with_steps(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Day-on-day change of columns as ``<name>_step`` (NULL at the head)."""
    ws = series_window(keys)
    return df.withColumns({f"{c}_step": F.col(c) - F.lag(c).over(ws) for c in cols})


def ratchet_rules(cols: Sequence[str]) -> list[RowRule]:
    """State that may only grow; run on a table prepared by :func:`with_steps`."""
    return [RowRule(f"{c}_never_falls", F.col(f"{c}_step") >= -1e-9, scope=F.col(f"{c}_step").isNotNull()) for c in cols]


def state_rules(proxy: str = "groundwater_proxy", score: str = "instability_score", fos: str = "fos", events: str = "blast_occurs",
                rain: str = "rainfall_mm") -> list[GroupRule]:
    """Aggregate checks per world or zone: persistence, signs and event counts."""
    return [
        GroupRule("proxy_persists", F.corr(proxy, f"{proxy}_prev") > 0.5, F.corr(proxy, f"{proxy}_prev")),
        GroupRule("score_falls_with_fos", F.corr(score, fos) < -0.9, F.corr(score, fos)),
        GroupRule("rain_feeds_proxy", F.corr(rain, proxy) > 0, F.corr(rain, proxy)),
        GroupRule("has_events", F.count_if(events) > 0, F.count_if(events)),
        GroupRule("wet_share_plausible", F.avg((F.col(rain) > 0).cast("double")).between(0.05, 0.95), F.avg((F.col(rain) > 0).cast("double")))]


def completeness(df: DataFrame, keys: Sequence[str] = SERIES, day: str = "day_idx") -> DataFrame:
    """Series whose rows do not cover every day of the panel exactly once."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(day).alias("n_days"), F.max(day).alias("last_day"))
    days = df.agg(F.max(day) + 1).scalar()
    return per.where((F.col("n_rows") != days) | (F.col("n_days") != days))


def enum_violations(df: DataFrame, column: str, enum: str, enums: DataFrame) -> DataFrame:
    """Values outside the enumeration (anti-join on distinct values), with their counts."""
    seen = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = enums.where(F.col("enum") == enum).select("value")
    return seen.join(known, "value", "left_anti")


def functional_dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Determinant values that map to more than one dependent value."""
    return df.groupBy(determinant).agg(F.min(dependent).alias("_lo"), F.max(dependent).alias("_hi")).where("_lo <> _hi").select(determinant)


def cross_zone_equality(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per key, whether all zones agree on the columns (site-wide drivers must)."""
    return df.groupBy(*by).agg(*[(F.max(c) - F.min(c) <= 1e-9).alias(f"{c}_equal") for c in columns])


def monotone_material_response(materials: DataFrame) -> DataFrame:
    """Susceptibility must not fall as weakness rises (a nine-row dimension)."""
    w = Window.orderBy("weakness", "material_class")
    s = materials.select("material_class", "weakness", P.susceptibility("weakness").alias("s"))
    step = s.withColumn("step", F.col("s") - F.lag("s").over(w))
    return step.agg(F.count_if(F.col("step") < 0).alias("n_violations"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ordinal_column(df: DataFrame, column: str, enum: str) -> DataFrame:
    return df.withColumn(f"{column}_level", S.ordinal(column, enum))
