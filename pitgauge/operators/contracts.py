"""Rules of the panel contract over whole groups: seasons, wet and dry spells, thrust bands, blasting rates, depth caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgauge.operators.quality import GroupRule, RowRule
from pitgauge.operators.quantiles import exact_quantiles

# The limits of the contract in the rules below.
WET_SPELL_MM, DRY_SPELL_MM = 30.0, 5.0


def season_rules(value: str = "rainfall_mm", month: str = "month") -> list[GroupRule]:
    """The monsoon month is wetter than the dry one."""
    gap = F.avg(F.when(F.col(month) == 11, F.col(value))) - F.avg(F.when(F.col(month) == 2, F.col(value)))
    return [GroupRule("nov_above_feb", gap > 0, gap)]


def spell_rules(panel: DataFrame, by: Sequence[str], rain7: str = "rainfall_7d_mm", pore: str = "pore_kpa", score: str = "instability_score", kind: str = "kind") -> DataFrame:
    """(by..., rule_id, severity, passed, detail): wet spells raise pore pressure and score, and the upper tail of the confined floor's pore pressure.

    Groups pool all zones and have no bound, so their quantiles are the exact distributed ones. A group without both spells has no row.
    """
    rain = F.col(rain7)
    spell = F.when(rain > WET_SPELL_MM, "wet").when(rain < DRY_SPELL_MM, "dry")
    measures = F.array(*[F.struct(F.lit(m).alias("rule_id"), v.cast("double").alias("v")) for m, v in (
        ("wet_raises_pore", F.col(pore)), ("wet_raises_score", F.col(score)), ("floor_tail_rises", F.when(F.col(kind) == "floor", F.col(pore))))])
    rows = panel.select(*by, spell.alias("spell"), F.inline(measures)).where("spell is not null and v is not null")
    q = exact_quantiles(rows, "v", [0.5, 0.9], [*by, "rule_id", "spell"])
    pick = lambda s, p: F.max(F.when((F.col("spell") == s) & (F.col("prob") == p), F.col("quantile")))
    wide = q.groupBy(*by, "rule_id").agg(pick("wet", 0.5).alias("w"), pick("wet", 0.9).alias("t"), pick("dry", 0.5).alias("d"))
    gap = F.when(F.col("rule_id") == "floor_tail_rises", F.col("t")).otherwise(F.col("w")) - F.col("d")
    return wide.where(gap.isNotNull()).select(*by, "rule_id", F.lit("error").alias("severity"), (gap > 0).alias("passed"), gap.alias("detail"))


def thrust_rules(thrust: str = "thrust", lo: str = "thrust_lo", hi: str = "thrust_hi") -> list[RowRule]:
    """Groundwater thrust inside its zone's band (columns joined from the zones)."""
    return [RowRule("thrust_in_band", F.col(thrust).between(F.col(lo), F.col(hi)))]


def confined_rules(thrust: str = "thrust", zone: str = "zone_code", confined: str = "ZONE_D", other: str = "ZONE_A") -> list[GroupRule]:
    """The confined aquifer has the highest thrust, and a grounded one."""
    of = lambda z: F.max(F.when(F.col(zone) == z, F.col(thrust)))
    return [GroupRule("confined_zone_highest", (of(confined) > of(other)) & of(confined).between(490, 785), of(confined))]


def blast_rate_rules(occurs: str = "blast_occurs", zone: str = "zone_code", frequency: str = "frequency_hz", blasted: tuple[str, str] = ("ZONE_A", "ZONE_B")) -> list[GroupRule]:
    """Weekly rates per series of the two blasted zones, their events, and the share of low frequencies. Rows are series-days."""
    at = lambda z: F.col(zone) == z
    events = [F.count_if(F.col(occurs) & at(z)) for z in blasted]
    rates = [F.try_divide(7.0 * n, F.count_if(at(z))) for z, n in zip(blasted, events)]
    low = F.avg(F.when(F.col(occurs), (F.col(frequency) < 8).cast("double")))
    rules = [GroupRule("rate_conserved", (rates[0] + rates[1]).between(14, 28), rates[0] + rates[1]), GroupRule("rate_shared", F.least(*rates) > 0, F.least(*rates))]
    for z, n, r in zip(blasted, events, rates):
        rules += [GroupRule(f"rate_in_band_{z}", r.between(5, 25), r), GroupRule(f"many_events_{z}", n > 30, n)]
    return [*rules, GroupRule("low_frequency_share", low.between(0.30, 0.65), low)]


def frequency_rules(frequency: str = "frequency_hz", occurs: str = "blast_occurs") -> list[RowRule]:
    return [RowRule("frequency_range", F.col(frequency).between(5, 27), scope=F.col(occurs))]


def score_rules(score: str = "instability_score", fos: str = "fos") -> list[GroupRule]:
    """The score is a falling line in stability but for rounding."""
    return [GroupRule("score_anti_correlated", F.corr(score, fos) < -0.99, F.corr(score, fos))]


def cap_rates(panel: DataFrame, series: Sequence[str], zone: str = "zone_code", depth: str = "depth_m", cap: str = "cap", most: float = 0.65) -> DataFrame:
    """(zone, n_series, cap_rate, passed): the share of a zone's series that ever reach their depth cap."""
    per = panel.groupBy(*series, zone).agg(F.max((F.col(depth) >= F.col(cap) - 1e-9).cast("double")).alias("_hit"))
    return per.groupBy(zone).agg(F.count(F.lit(1)).alias("n_series"), F.avg("_hit").alias("cap_rate")).withColumn("passed", F.col("cap_rate") <= most)
