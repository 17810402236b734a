"""The causal chain of a site panel: rain -> memory -> crack growth -> damage -> stability -> score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from pitgauge.functions import physics as P
from pitgauge.operators import windows as W


def crack_chain(panel: DataFrame, ws: WindowSpec) -> DataFrame:
    """Growth terms, growth, capped width and depth, then severity, density and family."""
    terms = P.crack_growth_terms(
        proxy="groundwater_proxy", slope="slope", weakness="weakness", clay="clay", ppv="ppv", blast_day="blast_occurs",
        blastable="blastable", thrust="thrust", dry_days="dry_days", zone_kind="kind", zone_id="zone_code")
    grown = panel.withColumns({f"t_{n}": c for n, c in terms.items()})
    first, *rest = terms
    grown = grown.withColumn("growth_mm", sum((F.col(f"t_{n}") for n in rest), F.col(f"t_{first}")))
    width_cap = F.when(F.col("kind") == "floor", 60.0).otherwise(150.0)
    sized = grown.withColumns({"width_mm": W.capped_total("growth_mm", 0.85, width_cap, ws),
                               "depth_m": W.capped_total("growth_mm", 0.012, "cap", ws)})
    return sized.withColumns({
        "water_filled": P.water_filled("wet_day", "rainfall_7d_mm", "groundwater_proxy"),
        "crack_severity": P.crack_severity("depth_m", "cap"),
        "density": P.crack_density(F.lit(0.3), "depth_m", "cap", "growth_mm"),
        "crack_family": P.dominant_driver({n: F.col(f"t_{n}") for n in terms}, "depth_m", "width_mm", "kind")})


def with_rain_state(panel: DataFrame, ws: WindowSpec) -> DataFrame:
    return panel.withColumns({
        "dry_days": W.run_length(~F.col("wet_day"), ws), "rainfall_3d_mm": W.trailing_sum("rainfall_mm", 3, ws),
        "rainfall_7d_mm": W.trailing_sum("rainfall_mm", 7, ws)})


def with_stability(panel: DataFrame) -> DataFrame:
    """Pore pressure, factor of safety, label and score from the current crack and water state."""
    wet = panel.withColumn("pore_kpa", P.pore_pressure("thrust", "groundwater_proxy"))
    cols = P.stability_columns("cohesion", "phi", "gamma", "height", "theta", "face", "groundwater_proxy", "density",
                               "crack_severity", "water_filled", "pore_kpa", "kind")
    return wet.withColumns(cols).withColumns({
        "risk_label": P.risk_label("fos"), "instability_score": P.instability_score("fos")})


def recompute(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything derived from rain and blasting, for series identified by ``keys``.

    All windows partition by ``keys``; when the input is already partitioned by a subset of
    them (a panel whose scenarios were exploded in place), no further exchange is needed.
    """
    ws = W.series_window(keys)
    state = panel.withColumn("wet_day", P.wet_day("rainfall_mm"))
    state = W.with_long_memory(state, F.col("rainfall_mm"), "groundwater_proxy", keys)
    return with_stability(crack_chain(with_rain_state(state, ws), ws))
