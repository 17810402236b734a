"""Score bands, confidence, display strings, distances and path helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitgauge.functions.physics import _c, clip, ladder
from pitgauge.schemas import ENUMS


def score_band(score) -> Column:
    return ladder(score, [(50, "Very Low"), (65, "Low"), (75, "Moderate"), (85, "High")], "Critical")


def event_flag(score, threshold: float = 75) -> Column:
    return (_c(score) >= threshold).cast("int")


def confidence(score, calibrated=None) -> Column:
    """Calibrated probability clamped to [0,1]; score/100 where none is known."""
    fallback = _c(score) / 100.0
    p = fallback if calibrated is None else F.coalesce(_c(calibrated), fallback)
    return F.bround(clip(p, 0.0, 1.0), 3)


def round_score(raw) -> Column:
    return F.bround(clip(raw, 0.0, 100.0), 0).cast("int")


def planar_distance(lat1, lng1, lat2, lng2) -> Column:
    return F.sqrt(F.pow(_c(lat1) - _c(lat2), F.lit(2.0)) + F.pow(_c(lng1) - _c(lng2), F.lit(2.0)))


def edge_cost(length, worst_risk, alpha) -> Column:
    """Length weighted by the worst adjacent risk; NULL for inputs outside the contract."""
    length, worst_risk, alpha = _c(length), _c(worst_risk), _c(alpha)
    finite = ~F.isnan(length.cast("double")) & (F.abs(length) < float("inf"))
    valid = finite & (length >= 0) & (alpha >= 0) & worst_risk.between(0, 100)
    return F.when(valid, length * (1.0 + alpha * worst_risk))


def band_upper(band) -> Column:
    """Upper case with the first blank replaced."""
    return F.regexp_replace(F.upper(F.coalesce(_c(band), F.lit(""))), "^([^ ]*) ", "$1_")


def capitalise(text) -> Column:
    text = _c(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def confidence_pct(conf) -> Column:
    conf = _c(conf)
    return F.floor(F.coalesce(F.when(conf <= 1, conf * 100.0).otherwise(conf), F.lit(0.0)) + 0.5).cast("long")


def key_suffix(key) -> Column:
    return F.element_at(F.split(_c(key), "_"), -1)


def day_label(start, day_idx) -> Column:
    return F.date_format(F.date_add(_c(start), _c(day_idx)), "MMM dd")


# The display texts of urgency() and zone_status().
def urgency(priority) -> Column:
    p = _c(priority)
    return (F.when(p == "immediate", "Immediate Action").when(p == "high", "High Priority")
            .when(p == "standby", "Standby").otherwise("Operational"))


def zone_status(band) -> Column:
    b = band_upper(band)
    return (F.when(b == "CRITICAL", "Critical - active monitoring").when(b == "HIGH", "Elevated risk")
            .otherwise("Normal Operations"))


def route_deltas(base_cost, aware_cost, base_risk, aware_risk, digits: int = 2) -> dict[str, Column]:
    """Extra distance, extra minutes at 1.5 per unit, and the share of risk avoided (0 without risk)."""
    delta = _c(aware_cost) - _c(base_cost)
    pct = F.when(_c(base_risk) > 0, F.floor((_c(base_risk) - _c(aware_risk)) / _c(base_risk) * 100.0 + 0.5)).otherwise(0)
    return {"distance_delta": F.round(delta, digits), "time_delta_min": F.round(delta * 1.5, digits - 1),
            "risk_reduction_pct": pct.cast("long")}


def with_midpoints(points) -> Column:
    """Insert the rounded mean between consecutive (lat, lng) structs of an array."""
    points = _c(points)
    legs = F.arrays_zip(
        F.slice(points, F.lit(1), F.size(points) - 1).alias("a"),
        F.slice(points, F.lit(2), F.size(points) - 1).alias("b"))
    spread = F.transform(legs, lambda leg: F.array(
        leg["a"],
        F.struct(F.bround((leg["a"]["lat"] + leg["b"]["lat"]) / 2.0, 5).alias("lat"),
                 F.bround((leg["a"]["lng"] + leg["b"]["lng"]) / 2.0, 5).alias("lng"))))
    return F.when(F.size(points) < 2, points).otherwise(
        F.concat(F.flatten(spread), F.slice(points, F.size(points), F.lit(1))))


def triangular_profile(k, duration, peak) -> Column:
    """Overlay of day k (1-based) of a storm that rises to ``peak`` and falls."""
    k, duration = _c(k), _c(duration)
    return _c(peak) * F.least(k, duration - k + 1).cast("double") / ((duration + 1).cast("double") / 2.0)


def ordinal(value, enum: str) -> Column:
    """Position of a category in its enumeration; NULL when it is not a member."""
    members = F.array(*[F.lit(v) for v in ENUMS[enum]])
    pos = F.array_position(members, _c(value))
    return F.when(pos > 0, (pos - 1).cast("int"))


# The cause texts and their limits.
def cause_strings(*, d_rain, d_proxy, sev_prev, sev_cur, blast, ppv, filled_prev, filled_cur) -> Column:
    """Texts of the physical changes that may explain a score move, in a fixed order."""
    return F.array_compact(F.array(
        F.when(_c(d_rain) >= 10, F.format_string("heavy rainfall (+%.0f mm/24h)", _c(d_rain))),
        F.when(_c(d_proxy) >= 15, F.format_string("groundwater proxy rose (+%.0f mm)", _c(d_proxy))),
        F.when(_c(sev_prev) != _c(sev_cur), F.concat(F.lit("crack severity "), _c(sev_prev), F.lit(" -> "), _c(sev_cur))),
        F.when(_c(blast), F.format_string("blast event (PPV %.1f mm/s)", _c(ppv))),
        F.when(_c(filled_cur) & ~_c(filled_prev), F.lit("cracks became water-filled")),
    ))
