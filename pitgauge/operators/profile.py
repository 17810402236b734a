"""Climatology profiles of daily series.

Groups here are the days of a station (or of one month or year of it), bounded by the calendar,
so the built-in exact ``percentile`` is safe; unbounded pools use ``exact_quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitgauge.operators.windows import full_frame_sum
from pitgauge.operators.quantiles import exact_quantiles, quantile_columns

HEAVY_MM = 64.5


def _pct(col, p):
    return F.percentile(col, F.lit(p))


def integrity_profile(series: DataFrame, by: Sequence[str] = ("station_id",)) -> DataFrame:
    v = F.col("value")
    return series.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count_if(v.isNull()).alias("n_null"), (F.count("day") - F.count_distinct("day")).alias("n_duplicate_days"),
        F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"), F.count_if(v > 0).alias("n_wet"),
        (F.avg((v == 0).cast("double")) * 100.0).alias("zero_pct"))


def distribution(series: DataFrame, value: str = "value", by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Quantiles, maximum, mean and population deviation of a calendar-bounded series."""
    v = F.col(value)
    return series.groupBy(*by).agg(
        F.count(v).alias("n"), _pct(v, 0.5).alias("p50"), _pct(v, 0.9).alias("p90"), _pct(v, 0.95).alias("p95"),
        _pct(v, 0.99).alias("p99"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"),
        F.stddev_pop(v).alias("std_value"))


def rolling_totals(series: DataFrame, windows: Sequence[int] = (1, 3, 7), by: Sequence[str] = ("station_id",)) -> DataFrame:
    ws = Window.partitionBy(*by).orderBy("day")
    return series.select("*", *[full_frame_sum("value", n, ws).alias(f"sum_{n}d") for n in windows])


def annual_stats(series: DataFrame, heavy: float = HEAVY_MM, by: Sequence[str] = ("station_id",)) -> DataFrame:
    v = F.col("value")
    return series.groupBy(*by, F.year("day").alias("year")).agg(
        F.sum(v).alias("total"), F.avg(v).alias("daily_mean"), F.count_if(v > 0).alias("wet_days"),
        F.count_if(v >= heavy).alias("heavy_days"), F.max(v).alias("max_day"), F.count(v).alias("n_days"))


def annual_distribution(annual: DataFrame, by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Spread of the yearly totals (an aggregate of an aggregate)."""
    t = F.col("total")
    return annual.groupBy(*by).agg(
        F.count(t).alias("n_years"), F.min(t).alias("min_total"), _pct(t, 0.25).alias("p25"), _pct(t, 0.5).alias("p50"),
        _pct(t, 0.75).alias("p75"), F.max(t).alias("max_total"), F.avg(t).alias("mean_total"),
        F.stddev_pop(t).alias("std_total"))


def annual_threshold_counts(annual: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Years above each total."""
    rows = annual.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return rows.groupBy(*by, "threshold").agg(
        F.count_if(F.col("total") >= F.col("threshold")).alias("n_years"),
        F.count_if(F.col("max_day") >= F.col("threshold")).alias("n_years_max_day"))


def monthly_climatology(series: DataFrame, by: Sequence[str] = ("station_id",)) -> DataFrame:
    v = F.col("value")
    return series.groupBy(*by, F.month("day").alias("month")).agg(
        F.sum(v).alias("total"), F.avg(v).alias("daily_mean"), _pct(v, 0.9).alias("p90"), _pct(v, 0.95).alias("p95"),
        _pct(v, 0.5).alias("median_value"), F.count_if(v > 0).alias("wet_days"),
        F.avg((v > 0).cast("double")).alias("wet_frequency"))


def seasonal_share(series: DataFrame, by: Sequence[str] = ("station_id",)) -> DataFrame:
    m, v = F.month("day"), F.col("value")
    return series.groupBy(*by).agg(
        F.sum(v).alias("total"),
        (F.sum(F.when(m.between(10, 12), v).otherwise(0.0)) / F.sum(v)).alias("share_oct_dec"),
        (F.sum(F.when(m == 11, v).otherwise(0.0)) / F.sum(v)).alias("share_nov"))


def compare_periods(series: DataFrame, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """Monthly means of two year ranges side by side, from one scan and one aggregate."""
    y, v = F.year("day"), F.col("value")
    a, b = F.when(y.between(*first), v), F.when(y.between(*second), v)
    return series.groupBy(F.month("day").alias("month")).agg(
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), (F.avg(b) - F.avg(a)).alias("mean_change"),
        F.avg((a > 0).cast("double")).alias("wet_a"), F.avg((b > 0).cast("double")).alias("wet_b"))


def top_days(series: DataFrame, n: int = 20) -> DataFrame:
    """The n largest days, earlier day first on ties (take-ordered, no global sort)."""
    return series.orderBy(F.col("value").desc(), "day").limit(n)


def ranked_extremes(series: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """The n largest days of each series; the rank filter is applied before the exchange."""
    w = Window.partitionBy(*by).orderBy(F.col("value").desc(), "day")
    return series.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def intensity_curve(series: DataFrame, by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Rank of every wet day by intensity."""
    w = Window.partitionBy(*by).orderBy(F.col("value").desc(), "day")
    return series.where(F.col("value") > 0).withColumn("rank", F.row_number().over(w))


def top_event_share(series: DataFrame, by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Share of its year that the largest day of the series made up."""
    v = F.col("value")
    best = F.max_by(F.struct("day", "value"), F.struct(v, F.negate(F.unix_date("day"))))
    yearly = series.groupBy(*by, F.year("day").alias("year")).agg(F.sum(v).alias("year_total"), best.alias("b"))
    pick = F.max_by(F.struct("b", "year_total"), F.struct(F.col("b.value"), F.negate(F.unix_date("b.day"))))
    return yearly.groupBy(*by).agg(pick.alias("t")).select(
        *by, F.col("t.b.day").alias("day"), F.col("t.b.value").alias("value"), F.col("t.year_total").alias("year_total"),
        (F.col("t.b.value") / F.col("t.year_total") * 100.0).alias("share_pct"))


def wet_dry_transitions(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """First-order wet/dry chain per month; a probability is NULL when its class is empty."""
    ws = Window.partitionBy(*by).orderBy("day")
    wet = (F.col("value") > 0).cast("double")
    prev = F.lag(wet).over(ws)
    rows = series.select(*by, F.month("day").alias("month"), wet.alias("wet"), prev.alias("prev"))
    return rows.groupBy("month").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("wet").alias("p_wet"),
        F.avg(F.when(F.col("prev") == 1, F.col("wet"))).alias("p_wet_after_wet"),
        F.avg(F.when(F.col("prev") == 0, F.col("wet"))).alias("p_wet_after_dry"))


def wet_day_pools(series: DataFrame, min_pool: int = 1) -> DataFrame:
    """Intensity quantiles of wet days per month; thin months take the pooled values."""
    probs = {0.1: "q10", 0.5: "q50", 0.9: "q90"}
    wet = series.where(F.col("value") > 0)

    by_month = wet.select(F.month("day").alias("month"), "value")
    months = series.groupBy(F.month("day").alias("month")).agg(F.count(F.lit(1)).alias("n_days"))
    counts = by_month.groupBy("month").agg(F.count("value").alias("n_wet"))
    per_month = counts.join(quantile_columns(exact_quantiles(by_month, "value", list(probs), ["month"]), ["month"], probs), "month", "left")
    pooled = quantile_columns(exact_quantiles(wet, "value", list(probs)), [], probs)
    joined = months.join(per_month, "month", "left")
    enough = F.coalesce(F.col("n_wet"), F.lit(0)) >= min_pool
    return joined.select(
        "month", "n_days", F.coalesce("n_wet", F.lit(0)).alias("n_wet"),
        *[F.when(enough, F.col(n)).otherwise(pooled.select(n).scalar()).alias(n) for n in probs.values()])


def period_summary(series: DataFrame, by: Sequence[str] = ("station_id",)) -> DataFrame:
    """All-day, wet-day and rolling statistics of a period in one row per series."""
    v = F.col("value")
    wet = F.when(v > 0, v)
    rolled = rolling_totals(series, (3, 7), by)
    return rolled.groupBy(*by).agg(
        F.count(v).alias("n"), (F.avg((v == 0).cast("double")) * 100.0).alias("zero_pct"), F.avg(v).alias("mean_all"),
        _pct(v, 0.95).alias("p95_all"), F.avg(wet).alias("mean_wet"), _pct(wet, 0.5).alias("p50_wet"),
        _pct(wet, 0.99).alias("p99_wet"), _pct(F.col("sum_3d"), 0.99).alias("p99_3d"), F.max("sum_7d").alias("max_7d"))


def across_worlds(summaries: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Mean of each measure over per-world summaries."""
    return summaries.agg(F.count(F.lit(1)).alias("n_worlds"), *[F.avg(m).alias(m) for m in measures])


def binned_mean(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Mean of y over equal-width, right-closed bins of x (edges from one prior aggregate)."""
    bounds = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    ranged = df.select(x, y, bounds.alias("_r"))
    width = (F.col("_r.hi") - F.col("_r.lo")) / bins
    pos = F.greatest(F.ceil((F.col(x) - F.col("_r.lo")) / width), F.lit(1))
    return ranged.groupBy(F.least(pos, F.lit(bins)).cast("int").alias("bin")).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean_y"))


def rounded_buckets(df: DataFrame, x: str, y: str, n: int = 8, digits: int = 1) -> DataFrame:
    """Mean of y for the first n values of x rounded."""
    return (df.groupBy(F.round(x, digits).alias("bucket")).agg(F.count(y).alias("n"), F.avg(y).alias("mean_y"))
            .orderBy("bucket").limit(n))


def wet_dry_contrast(df: DataFrame, value: str, wet: str, by: Sequence[str] = ()) -> DataFrame:
    """Median of a value on wet and on dry days of a pool of any size."""
    q = exact_quantiles(df, value, [0.5], [*by, wet])
    agg = [F.max(F.when(F.col(wet), F.col("quantile"))).alias("median_wet"),
           F.max(F.when(~F.col(wet), F.col("quantile"))).alias("median_dry")]
    return q.groupBy(*by).agg(*agg)


def histogram(df: DataFrame, value: str, lo: float, hi, bins: int) -> DataFrame:
    """Counts per equal-width bin of [lo, hi], the last bin closed on the right."""
    v = F.col(value).cast("double")
    hi = hi if not isinstance(hi, (int, float)) else F.lit(float(hi))
    ranged = df.select(v.alias("_v"), F.lit(float(lo)).alias("_lo"), hi.alias("_hi"))
    inside = ranged.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    bin_no = F.floor((F.col("_v") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins))
    return inside.groupBy(F.least(bin_no, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def event_accumulations(series: DataFrame, events: DataFrame, value: str = "value") -> DataFrame:
    """1/3/7-day totals ending on each event date and the span of +-6 days around it.

    Each event is expanded to its 13 calendar days and equi-joined on the day.
    """
    days = events.select("event_id", F.col("event_day"), F.explode(F.sequence(F.lit(-6), F.lit(6))).alias("offset"))
    days = days.withColumn("day", F.date_add("event_day", F.col("offset")))
    hit = series.join(days, "day")
    v, o = F.col(value), F.col("offset")

    def total(n):
        return F.coalesce(F.sum(F.when(o.between(-(n - 1), 0), v)), F.lit(0.0)).alias(f"sum_{n}d")

    return hit.groupBy("event_id", "event_day").agg(
        total(1), total(3), total(7), F.count_if(o.between(-6, 0)).alias("days_in_7d"),
        F.count(F.lit(1)).alias("excerpt_days"), F.max(v).alias("excerpt_max"))
