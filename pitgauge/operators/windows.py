"""Trailing-window features over a dense daily panel.

All frames end at the current row, so a feature of day t never sees day t+1.
Every function takes a :class:`WindowSpec` made by :func:`series_window`; a job that
uses one spec throughout needs a single exchange and a single sort. The rows of one
window group are the days of one series, a calendar bound (45,000 rows in 124
years), whatever share of the raw readings that series holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitgauge.functions.physics import TAU_DAYS, _c

SERIES = ("seed", "zone_id")
HEAVY_RAIN_MM = 25.0
BLOCK_DAYS = 2048


def series_window(keys: Sequence[str] = SERIES, order: str = "day_idx") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _back(ws: WindowSpec, n: int) -> WindowSpec:
    return ws.rowsBetween(-(n - 1), 0)


def _so_far(ws: WindowSpec) -> WindowSpec:
    return ws.rowsBetween(Window.unboundedPreceding, 0)


def trailing_sum(x, n: int, ws: WindowSpec) -> Column:
    """Sum of the last n days; shorter frames at the head are allowed."""
    return F.sum(_c(x)).over(_back(ws, n))


def full_frame_sum(x, n: int, ws: WindowSpec) -> Column:
    """Sum of the last n days, NULL until n values exist."""
    frame = _back(ws, n)
    return F.when(F.count(_c(x)).over(frame) == n, F.sum(_c(x)).over(frame))


def trailing_max(x, n: int, ws: WindowSpec) -> Column:
    return F.max(_c(x)).over(_back(ws, n))


def k_day_change(x, k: int, ws: WindowSpec) -> Column:
    """x(t) - x(t-k), 0 for the first k days."""
    return F.coalesce(_c(x) - F.lag(_c(x), k).over(ws), F.lit(0.0))


def clipped_growth_sum(g, n: int, ws: WindowSpec) -> Column:
    return F.sum(F.greatest(_c(g), F.lit(0.0))).over(_back(ws, n))


def run_length(cond, ws: WindowSpec, day="day_idx") -> Column:
    """Consecutive days, ending today, on which ``cond`` holds."""
    cond, day = _c(cond), _c(day)
    last_break = F.max(F.when(~cond, day)).over(_so_far(ws))
    start = F.first(day).over(_so_far(ws)) - 1
    return day - F.coalesce(last_break, start)


def days_since(cond, ws: WindowSpec, day="day_idx") -> Column:
    """Days since ``cond`` last held; position + 1 before it ever did."""
    cond, day = _c(cond), _c(day)
    last_hit = F.max(F.when(cond, day)).over(_so_far(ws))
    start = F.first(day).over(_so_far(ws)) - 1
    return day - F.coalesce(last_hit, start)


def exponential_memory(x, ws: WindowSpec, tau: float = TAU_DAYS, day="day_idx") -> Column:
    """m(t) = exp(-1/tau) m(t-1) + x(t), as a prefix sum; for series up to ``BLOCK_DAYS``."""
    age = _c(day).cast("double") / tau
    return F.exp(-age) * F.sum(_c(x) * F.exp(age)).over(_so_far(ws))


def with_long_memory(df: DataFrame, x, name: str, keys: Sequence[str] = SERIES, tau: float = TAU_DAYS,
                     day: str = "day_idx", block_days: int = BLOCK_DAYS) -> DataFrame:
    """The same memory as column ``name``, free of overflow for series of any length.

    Days are grouped in blocks and the exponent restarts in each; a block adds the decayed
    value its predecessor ended with. What lies two blocks back has decayed by
    exp(-block_days/tau), below one part in 1e70 with the defaults. Both windows need the
    order (keys, block, day), so one exchange and one sort serve them.
    """
    pos = F.pmod(F.col(day), F.lit(block_days)).cast("double")
    inner = Window.partitionBy(*keys, "_block").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block", day).rowsBetween(Window.unboundedPreceding, -1)
    local = (df.withColumn("_block", F.floor(F.col(day) / block_days))
             .withColumn("_local", F.exp(-pos / tau) * F.sum(_c(x) * F.exp(pos / tau)).over(inner)))
    block_end = F.when(pos == block_days - 1, F.col("_local"))
    carry = F.last(block_end, ignorenulls=True).over(before)
    return local.withColumn(
        name, F.col("_local") + F.coalesce(carry, F.lit(0.0)) * F.exp(-(pos + 1.0) / tau)).drop("_local", "_block")


def capped_total(growth, gain: float, cap, ws: WindowSpec) -> Column:
    """Running total of non-negative growth, held at ``cap`` (exact because growth >= 0)."""
    return F.least(_c(cap), F.sum(_c(growth) * gain).over(_so_far(ws)))


def position(ws: WindowSpec) -> Column:
    return F.row_number().over(ws) - 1


def future_value(y, horizon: int, ws: WindowSpec) -> Column:
    return F.lead(_c(y), horizon).over(ws)


def trend_of_last3(score, ws: WindowSpec) -> Column:
    """stable / rising / rapidly_increasing from the last three scores."""
    s0, s1, s2 = F.lag(_c(score), 2).over(ws), F.lag(_c(score), 1).over(ws), _c(score)
    rapid = ((s1 - s0 >= 8) & (s2 - s1 >= 8)) | (s2 - s0 >= 25)
    return (F.when(s0.isNull(), F.lit("stable")).when(rapid, F.lit("rapidly_increasing"))
            .when(s2 > s0, F.lit("rising")).otherwise(F.lit("stable")))


def recent_history(ws: WindowSpec, *cols: str, n: int = 12) -> Column:
    return F.collect_list(F.struct(*cols)).over(_back(ws, n))


def downward_crossing(fos, ws: WindowSpec, level: float = 1.0, calm: float | None = None,
                      lookback: int = 30, from_position: int = 30) -> Column:
    """fos falls below ``level``; with ``calm``, only after ``lookback`` days all at or above it."""
    fos = _c(fos)
    hit = (fos < level) & (F.lag(fos).over(ws) >= level) & (position(ws) >= from_position)
    if calm is not None:
        hit = hit & (F.min(fos).over(ws.rowsBetween(-lookback, -1)) >= calm)
    return F.coalesce(hit, F.lit(False))


def warning_lead(warned, ws: WindowSpec, horizon: int = 10, day="day_idx") -> Column:
    """Days between the first warning inside the horizon and today; NULL without one."""
    day = _c(day)
    return day - F.min(F.when(_c(warned), day)).over(ws.rowsBetween(-horizon, -1))


def changed(x, ws: WindowSpec) -> Column:
    return F.coalesce(_c(x) != F.lag(_c(x)).over(ws), F.lit(False))


def sequence_window(ws: WindowSpec, cols: Sequence[str], length: int = 14) -> Column:
    """Array of the last ``length`` days as structs; NULL until that many exist."""
    arr = F.collect_list(F.struct(*cols)).over(_back(ws, length))
    return F.when(F.size(arr) == length, arr)


# Names of the contract's trailing features.
TEMPORAL_FEATURES = [
    "rainfall_3d_mm", "rainfall_14d_mm", "max_rainfall_7d_mm", "consecutive_wet_days", "days_since_heavy_rain",
    "gw_delta_1d", "gw_delta_3d", "gw_delta_7d", "gw_rise_rate_7d",
    "crack_growth_1d", "crack_growth_3d", "crack_growth_7d", "crack_accel_3d", "cum_growth_30d",
    "ppv_max_3d", "ppv_max_7d", "blast_count_3d", "blast_count_7d", "cum_ppv_7d", "days_since_last_blast",
]


def temporal_features(panel: DataFrame, keys: Sequence[str] = SERIES, ppv: str = "ppv") -> DataFrame:
    """The twenty trailing features of rain, groundwater, cracks and vibration.

    Two select levels (the growth column feeds two further windows), one window spec:
    a single exchange by series.
    """
    ws = series_window(keys)
    rain, gw, cd, v = F.col("rainfall_mm"), F.col("groundwater_proxy"), F.col("crack_density"), F.col(ppv)
    hit = F.when(v > 0, 1.0).otherwise(0.0)
    first = panel.select(
        "*",
        trailing_sum(rain, 3, ws).alias("rainfall_3d_mm"),
        trailing_sum(rain, 14, ws).alias("rainfall_14d_mm"),
        trailing_max(rain, 7, ws).alias("max_rainfall_7d_mm"),
        run_length("wet_day", ws).cast("double").alias("consecutive_wet_days"),
        days_since(rain >= HEAVY_RAIN_MM, ws).cast("double").alias("days_since_heavy_rain"),
        k_day_change(gw, 1, ws).alias("gw_delta_1d"),
        k_day_change(gw, 3, ws).alias("gw_delta_3d"),
        k_day_change(gw, 7, ws).alias("gw_delta_7d"),
        (k_day_change(gw, 7, ws) / 7.0).alias("gw_rise_rate_7d"),
        k_day_change(cd, 1, ws).alias("crack_growth_1d"),
        k_day_change(cd, 3, ws).alias("crack_growth_3d"),
        k_day_change(cd, 7, ws).alias("crack_growth_7d"),
        trailing_max(v, 3, ws).alias("ppv_max_3d"),
        trailing_max(v, 7, ws).alias("ppv_max_7d"),
        trailing_sum(hit, 3, ws).alias("blast_count_3d"),
        trailing_sum(hit, 7, ws).alias("blast_count_7d"),
        trailing_sum(v, 7, ws).alias("cum_ppv_7d"),
        days_since(v > 0, ws).cast("double").alias("days_since_last_blast"),
    )
    g1 = F.col("crack_growth_1d")
    return first.select(
        "*",
        k_day_change(g1, 3, ws).alias("crack_accel_3d"),
        clipped_growth_sum(g1, 30, ws).alias("cum_growth_30d"),
    )


def causality_gap(panel: DataFrame, cuts: Sequence[int], keys: Sequence[str] = SERIES,
                  features: Sequence[str] = tuple(TEMPORAL_FEATURES)) -> DataFrame:
    """Largest difference, per cut day, between features of the full and the truncated panel.

    The panel is repeated once per cut with the later days removed, rebuilt, and compared on
    the cut day over all series at once; a causal feature set shows no difference.
    """
    cut = F.explode(F.array(*[F.lit(int(c)) for c in cuts]))
    truncated = panel.select("*", cut.alias("cut")).where(F.col("day_idx") <= F.col("cut"))
    rebuilt = (temporal_features(truncated, [*keys, "cut"]).where(F.col("day_idx") == F.col("cut"))
               .select(*keys, "cut", *[F.col(c).alias(f"t_{c}") for c in features]))
    full = (temporal_features(panel, keys).where(F.col("day_idx").isin([int(c) for c in cuts]))
            .select(*keys, F.col("day_idx").alias("cut"), *features))
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"t_{c}")) for c in features])
    return (full.join(rebuilt, [*keys, "cut"]).groupBy("cut")
            .agg(F.count("*").alias("n_series"), F.max(gap).alias("max_gap"),
                 F.count_if(gap > 1e-9).alias("n_failed")))


def decimate(df: DataFrame, max_points: int, keys: Sequence[str] = SERIES, day: str = "day_idx") -> DataFrame:
    """At most ``max_points`` evenly spaced rows per series (plus the last one)."""
    ws = series_window(keys, day)
    n = F.count("*").over(Window.partitionBy(*keys))
    pos = position(ws)
    sized = df.select("*", n.alias("_n"), pos.alias("_pos"))
    step = F.greatest(F.ceil(F.col("_n") / max_points), F.lit(1))
    return sized.where((F.col("_pos") % step == 0) | (F.col("_pos") == F.col("_n") - 1)).drop("_n", "_pos")
