"""Column expressions for rain, groundwater, vibration, cracks and slope stability.

Every function takes columns (or column names) and returns a column made of
built-in expressions, so whole-stage code generation covers them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RU_WET, RU_FILLED, RU_MAX, WET_SAT_MM = 0.35, 0.15, 0.55, 180.0
HEAVE_REF_KPA, FOS_CAP = 490.0, 2.5
TAU_DAYS = 12.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(x, lo: float, hi: float | None = None) -> Column:
    """Bound a column; a NULL stays NULL (``least``/``greatest`` would skip it)."""
    x = _c(x)
    bounded = F.greatest(x, F.lit(lo))
    bounded = bounded if hi is None else F.least(bounded, F.lit(hi))
    return F.when(x.isNotNull(), bounded)


def ladder(x, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First step whose bound is above ``x``; NULL and NaN give NULL."""
    x = _c(x)
    out = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(None).cast("string"))
    for bound, name in steps:
        out = out.when(x < F.lit(bound), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def rain_regime(mm) -> Column:
    mm = _c(mm)
    return (F.when(mm <= 0, "dry").when(mm <= 35.5, "normal").when(mm <= 64.5, "wet")
            .when(mm > 64.5, "storm"))


def wet_day(mm) -> Column:
    return _c(mm) > 0


def groundwater_state(kpa) -> Column:
    """Half-open pressure bands; a value outside all of them is critical."""
    kpa = _c(kpa)
    return (F.when((kpa >= 0) & (kpa < 60), "dry").when((kpa >= 60) & (kpa < 150), "normal")
            .when((kpa >= 150) & (kpa < 300), "elevated").when((kpa >= 300) & (kpa < 500), "high")
            .when(kpa.isNotNull(), "critical"))


def pore_pressure(thrust, wetness) -> Column:
    return _c(thrust) + F.lit(1.0) * _c(wetness)


def pore_ratio(proxy, filled) -> Column:
    wet = F.lit(RU_WET) * clip(_c(proxy) / WET_SAT_MM, 0.0, 1.0)
    return clip(wet + F.when(_c(filled), RU_FILLED).otherwise(0.0), 0.0, RU_MAX)


def cohesion_retention(density, severity, filled, face) -> Column:
    open_crack = (_c(severity) == "critical") & _c(filled) & (_c(face) >= 60)
    return F.when(open_crack, F.lit(0.5)).otherwise(1.0 - 0.10 * F.least(_c(density), F.lit(1.0)))


def bench_fos(cohesion, phi, gamma, height, theta, r_u, retention) -> Column:
    """Infinite-slope factor of safety, capped; undefined where the denominator is not positive."""
    th = F.radians(_c(theta))
    den = _c(gamma) * _c(height) * F.sin(th) * F.cos(th)
    num = (_c(cohesion) * _c(retention)
           + (1.0 - _c(r_u)) * _c(gamma) * _c(height) * F.pow(F.cos(th), F.lit(2.0)) * F.tan(F.radians(_c(phi))))
    return F.when(den > 0, F.least(num / den, F.lit(FOS_CAP)))


def floor_fos(pore_kpa, filled) -> Column:
    uplift = _c(pore_kpa) * (1.0 + F.when(_c(filled), RU_FILLED).otherwise(0.0))
    return F.when(_c(pore_kpa) <= 0, F.lit(FOS_CAP)).otherwise(F.lit(HEAVE_REF_KPA) / uplift)


def zone_fos(zone_kind, bench, floor) -> Column:
    return F.when(_c(zone_kind) == "floor", _c(floor)).otherwise(_c(bench))


def risk_label(fos) -> Column:
    return ladder(fos, [(0.8, "critical"), (1.0, "high"), (1.2, "moderate"), (1.5, "low")], "very_low")


def slope_condition(fos) -> Column:
    return ladder(fos, [(0.8, "failed"), (1.0, "unstable"), (1.2, "marginal")], "stable")


def instability_score(fos) -> Column:
    return F.bround(instability_raw(fos), 1)


def instability_raw(fos) -> Column:
    return clip(100.0 * (FOS_CAP - _c(fos)) / 2.0, 0.0, 100.0)


def peak_particle_velocity(distance_m, charge_kg, k, b, scatter=1.0) -> Column:
    """Attenuation law; 0 without a charge, capped at 100 mm/s."""
    scaled = _c(distance_m) / F.sqrt(_c(charge_kg))
    return F.when(_c(charge_kg) > 0, F.least(_c(k) * F.pow(scaled, -_c(b)) * _c(scatter), F.lit(100.0))).otherwise(0.0)


def susceptibility(weakness) -> Column:
    return 0.5 + 0.5 * _c(weakness)


def unit_weight(density) -> Column:
    return F.bround(_c(density) * 9.81 / 1000.0, 3)


# Coefficients, limits and families of crack growth in the functions below.
def crack_growth_terms(*, proxy, slope, weakness, clay, ppv, blast_day, blastable, thrust, dry_days,
                       zone_kind, zone_id, tension_activity=1.0, blast_activity=1.0) -> dict[str, Column]:
    """Daily opening per mechanism in mm; their sum is the growth rate."""
    proxy, s = _c(proxy), susceptibility(weakness)
    wn = clip(proxy / 60.0, 0.0, 3.0)
    steep = F.greatest(_c(slope) / 75.0, F.lit(0.0))
    is_floor = _c(zone_kind) == "floor"
    return {
        "tension": _c(tension_activity) * 0.18 * steep * s * (0.15 + 0.85 * clip(wn / 1.5, 0.0, 1.0)),
        "hydraulic": 0.6 * wn * s,
        "blast": F.when(_c(blastable) & _c(blast_day) & (_c(ppv) > 10),
                        _c(blast_activity) * 0.8 * F.greatest((_c(ppv) - 10.0) / 12.5, F.lit(0.0))).otherwise(0.0),
        "seepage": F.when((_c(zone_id) == "ZONE_B") & (proxy > 60), 0.45 * wn).otherwise(0.0),
        "desiccation": F.when((_c(clay) > 0.5) & (_c(dry_days) >= 14) & ~is_floor,
                              0.15 * _c(clay) * clip(_c(dry_days) / 30.0, 0.0, 1.0)).otherwise(0.0),
        "heave": F.when(is_floor, 0.5 * F.greatest(_c(thrust) / HEAVE_REF_KPA - 1.0, F.lit(0.0))
                        * (0.5 + 0.5 * wn)).otherwise(0.0),
    }


def water_filled(wet_today, rain_7d, proxy) -> Column:
    return _c(wet_today) | (_c(rain_7d) > 15) | (_c(proxy) > 60)


def dominant_driver(terms: dict[str, Column], depth, width, zone_kind) -> Column:
    """Family of the largest term (first wins); ``none`` until the crack is visible."""
    values = F.array(terms["tension"], terms["hydraulic"], terms["blast"], terms["seepage"],
                     terms["desiccation"], F.lit(0.0))
    families = F.array(*[F.lit(v) for v in (
        "tension_crest", "tension_crest", "blast_induced", "seepage", "desiccation", "tension_crest")])
    pick = F.element_at(families, F.array_position(values, F.array_max(values)).cast("int"))
    visible = (_c(depth) > 0.05) | (_c(width) > 1.0)
    return (F.when(~visible, F.lit("none")).when(_c(zone_kind) == "floor", F.lit("floor_heave")).otherwise(pick))


def crack_density(base, depth, cap, growth) -> Column:
    ratio = _c(depth) / F.greatest(_c(cap), F.lit(1e-6))
    return clip(_c(base) + 0.4 * clip(ratio * 2.0, 0.0, 1.0) + 0.2 * clip(_c(growth) / 10.0, 0.0, 1.0), 0.05, 2.5)


def crack_severity(depth, cap) -> Column:
    ratio = _c(depth) / F.greatest(_c(cap), F.lit(1e-6))
    return (F.when(ratio >= 0.49, "critical").when(ratio >= 0.33, "severe").when(ratio >= 0.20, "moderate")
            .when(ratio >= 0.10, "minor").when(ratio.isNotNull(), "normal"))


def inspection_clock(day_idx, offset, cadence) -> Column:
    return F.pmod(_c(day_idx) + _c(offset), _c(cadence))


def fos_per_pore_ratio(phi, theta) -> Column:
    return -F.tan(F.radians(_c(phi))) / F.tan(F.radians(_c(theta)))


def fos_per_tenth_retention(cohesion, gamma, height, theta) -> Column:
    th = F.radians(_c(theta))
    return 0.1 * _c(cohesion) / (_c(gamma) * _c(height) * F.sin(th) * F.cos(th))


def stability_columns(cohesion, phi, gamma, height, theta, face, proxy, density, severity, filled,
                      pore_kpa, zone_kind) -> dict[str, Column]:
    """The whole chain pore ratio -> factor of safety -> label and score, as named columns."""
    r_u = pore_ratio(proxy, filled)
    retention = cohesion_retention(density, severity, filled, face)
    fos = zone_fos(zone_kind, bench_fos(cohesion, phi, gamma, height, theta, r_u, retention),
                   floor_fos(pore_kpa, filled))
    return {"r_u": r_u, "retention": retention, "fos": fos}
