"""Statistics over the panel: correlations, contingency tables, audits and thresholds.

Everything is a sum-based aggregate with map-side partials; medians over unbounded pools go
through ``exact_quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgauge.operators.joins import lookup
from pitgauge.operators.quantiles import exact_quantiles, quantile_columns
from pitgauge.operators.windows import SERIES, series_window
from pitgauge.session import cut_lineage


def group_baselines(rows: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Smallest score and largest fos per zone, from training rows only."""
    return rows.where(F.col("split") == "train").groupBy(zone).agg(
        F.min("score").alias("base_score"), F.max("fos").alias("base_fos"))


def with_deltas(rows: DataFrame, baselines: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Targets relative to the zone's training baseline (NULL for unseen zones)."""
    return lookup(rows, baselines, zone, "left").select(
        "*", (F.col("score") - F.col("base_score")).alias("delta_score"), (F.col("fos") - F.col("base_fos")).alias("delta_fos"))


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Contingency table with a column per known category."""
    return df.groupBy(row).agg(*[
        F.count_if(F.col(col) == v).alias("n_" + v.lower().replace(" ", "_")) for v in values])


def stratified(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"))


def group_correlation(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("corr_xy"))


def mean_group_correlation(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    return group_correlation(df, x, y, by).agg(F.count("corr_xy").alias("n_groups"), F.avg("corr_xy").alias("mean_corr"))


def partial_correlation(df: DataFrame, x: str, y: str, u: str, v: str, by: Sequence[str]) -> DataFrame:
    """Correlation of x and y after regressing both on u and v, without an intercept.

    The residual moments follow from the fifteen sums of products, so one aggregate is enough.
    """
    cols = {"x": F.col(x), "y": F.col(y), "u": F.col(u), "v": F.col(v)}
    names = list(cols)
    sums = [F.count(F.lit(1)).cast("double").alias("n")] + [F.sum(cols[a]).alias(f"s{a}") for a in names]
    sums += [F.sum(cols[a] * cols[b]).alias(f"s{a}{b}") for i, a in enumerate(names) for b in names[i:]]
    s = df.groupBy(*by).agg(*sums)
    det = F.col("suu") * F.col("svv") - F.col("suv") * F.col("suv")

    def coef(t):
        tu, tv = F.col(f"s{t}u"), F.col(f"s{t}v")
        return ((tu * F.col("svv") - tv * F.col("suv")) / det, (tv * F.col("suu") - tu * F.col("suv")) / det)

    (bxu, bxv), (byu, byv) = coef("x"), coef("y")
    s = s.withColumns({"bxu": bxu, "bxv": bxv, "byu": byu, "byv": byv})
    c = F.col

    def resid_sum(t):
        return c(f"s{t}") - c(f"b{t}u") * c("su") - c(f"b{t}v") * c("sv")

    def resid_product(a, b):
        ab = "s" + "".join(sorted((a, b)))
        return (c(ab) - c(f"b{b}u") * c(f"s{a}u") - c(f"b{b}v") * c(f"s{a}v")
                - c(f"b{a}u") * c(f"s{b}u") - c(f"b{a}v") * c(f"s{b}v")
                + c(f"b{a}u") * c(f"b{b}u") * c("suu") + c(f"b{a}v") * c(f"b{b}v") * c("svv")
                + (c(f"b{a}u") * c(f"b{b}v") + c(f"b{a}v") * c(f"b{b}u")) * c("suv"))

    s = s.withColumns({"rx": resid_sum("x"), "ry": resid_sum("y"), "rxx": resid_product("x", "x"),
                       "ryy": resid_product("y", "y"), "rxy": resid_product("x", "y")})
    num = c("n") * c("rxy") - c("rx") * c("ry")
    den = F.sqrt(c("n") * c("rxx") - c("rx") * c("rx")) * F.sqrt(c("n") * c("ryy") - c("ry") * c("ry"))
    return s.select(*by, F.col("n").cast("long").alias("n"), (num / den).alias("partial_corr"))


def lagged_correlation(df: DataFrame, x: str, y: str, lags: Sequence[int], keys: Sequence[str] = SERIES,
                       by: Sequence[str] = ()) -> DataFrame:
    """corr(x(t-k), y(t)) for each lag, pooled over ``by``."""
    ws = series_window(keys)
    shifted = df.select(*by, F.col(y).alias("_y"), *[F.lag(x, k).over(ws).alias(f"_x{k}") for k in lags])
    wide = shifted.groupBy(*by).agg(*[F.corr(f"_x{k}", "_y").alias(f"c{k}") for k in lags])
    return wide.select(*by, F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag_days"), F.col(f"c{k}").alias("corr_xy")) for k in lags])))


def autocorrelation(df: DataFrame, x: str, keys: Sequence[str], order: str = "day_idx") -> DataFrame:
    """Lag-1 autocorrelation about the series mean."""
    ws = series_window(keys, order)
    mean = F.avg(x).over(Window.partitionBy(*keys))
    d = df.select(*keys, order, (F.col(x) - mean).alias("_d"))
    d = d.withColumn("_p", F.lag("_d").over(ws))
    return d.groupBy(*keys).agg((F.sum(F.col("_d") * F.col("_p")) / F.sum(F.col("_d") * F.col("_d"))).alias("lag1_autocorr"))


def most_frequent(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Most frequent category per group, the smaller one on ties; counted before ranking."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.col(col), F.struct(F.negate(F.col("_n")), F.col(col)))
    return counts.groupBy(*by).agg(best.alias("mode_value"), F.max("_n").alias("mode_count"))


def level_extremes(df: DataFrame, level: str, ordinal: Column, by: Sequence[str]) -> DataFrame:
    """Worst and second-worst distinct level of an ordered category (NULL with a single level)."""
    seen = df.select(*by, F.col(level).alias("_l"), ordinal.alias("_o")).distinct()
    w = Window.partitionBy(*by).orderBy(F.col("_o").desc())
    ranked = seen.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("_r") == 1, F.col("_l"))).alias("worst_level"),
                                   F.max(F.when(F.col("_r") == 2, F.col("_l"))).alias("second_worst_level"))


def event_contrast(df: DataFrame, value: str, event: str, by: Sequence[str]) -> DataFrame:
    """Maximum of a value and its mean on event and other days."""
    return df.groupBy(*by).agg(
        F.max(value).alias("max_value"), F.avg(F.when(F.col(event), F.col(value))).alias("mean_event"),
        F.avg(F.when(~F.col(event), F.col(value))).alias("mean_other"))


def level_span(df: DataFrame, label: str, ordinal: Column, value: str, by: Sequence[str]) -> DataFrame:
    """Number of labels seen, the best and the worst of them, and the value's range per group."""
    o = ordinal
    return df.groupBy(*by).agg(
        F.count_distinct(label).alias("n_labels"), F.min_by(F.col(label), o).alias("best_label"),
        F.max_by(F.col(label), o).alias("worst_label"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def series_audit(df: DataFrame, depth: str, cap: float, growth: str, acute: float,
                 keys: Sequence[str] = SERIES, day: str = "day_idx") -> DataFrame:
    """Per series: final and largest depth, largest growth, cap reached and days to it."""
    d = F.col(depth)
    return df.groupBy(*keys).agg(
        F.max_by(depth, day).alias("final_depth"), F.max(d).alias("max_depth"), F.max(growth).alias("max_growth"),
        F.avg((F.col(growth) > acute).cast("double")).alias("acute_share"),
        F.count_if(F.col(growth) > acute).alias("acute_days"),
        F.max((d >= cap - 1e-9).cast("int")).alias("hit_cap"),
        (F.min(F.when(d >= cap - 1e-9, F.col(day))) - F.min(day)).alias("days_to_cap"))


def audit_across_worlds(audits: DataFrame, by: Sequence[str]) -> DataFrame:
    """P50 and P90 of the per-series measures over all series of a group.

    A group may hold any number of series, so the quantiles take the distributed form.
    """
    by = list(by)
    audits = cut_lineage(audits.select(*by, "final_depth", "hit_cap", "days_to_cap", "max_growth", "acute_days"))
    depth = quantile_columns(exact_quantiles(audits, "final_depth", [0.5, 0.9], by), by, {0.5: "depth_p50", 0.9: "depth_p90"})
    days = quantile_columns(exact_quantiles(audits, "days_to_cap", [0.5], by), by, {0.5: "days_to_cap_p50"})
    sums = audits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_series"), F.avg("hit_cap").alias("cap_rate"), F.max("max_growth").alias("max_growth"),
        F.sum("acute_days").alias("acute_days"))
    return sums.join(depth, by).join(days, by, "left")


def static_columns(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Whether columns stay constant inside each group (min = max, no distinct sets)."""
    return df.groupBy(*by).agg(*[(F.min(c) == F.max(c)).alias(f"{c}_static") for c in cols])


def positive_growth(df: DataFrame, x: str, keys: Sequence[str] = SERIES) -> DataFrame:
    step = F.greatest(F.col(x) - F.lag(x).over(series_window(keys)), F.lit(0.0))
    return (df.select(*keys, step.alias("_g")).groupBy(*keys)
            .agg(F.coalesce(F.sum("_g"), F.lit(0.0)).alias("total_growth")))


def threshold_measures(df: DataFrame, score: str, threshold: float, keys: Sequence[str], day: str = "day_idx") -> DataFrame:
    """First day and number of days at or above a threshold, and the day of the peak."""
    hit = F.col(score) >= threshold
    return df.groupBy(*keys).agg(
        F.min(F.when(hit, F.col(day))).alias("first_day"), F.count_if(hit).alias("n_days"),
        F.max(score).alias("peak"), F.min_by(F.col(day), F.struct(F.negate(F.col(score)), F.col(day))).alias("peak_day"))


def closest_to_median(df: DataFrame, x: str, by: Sequence[str], tie: str) -> DataFrame:
    """The row whose value is nearest the group's median, for groups of any size."""
    med = exact_quantiles(df, x, [0.5], by).select(*by, F.col("quantile").alias("median_x"))
    gap = F.round(F.abs(F.col(x) - F.col("median_x")), 9)  # both middle rows of an even group are equally near
    joined = df.join(med, list(by))
    return joined.groupBy(*by).agg(F.max("median_x").alias("median_x"), F.min_by(F.struct(tie, x), F.struct(gap, F.col(tie))).alias("r")).select(
        *by, "median_x", F.col(f"r.{tie}").alias(tie), F.col(f"r.{x}").alias(x))


def sampled_row(df: DataFrame, by: Sequence[str], draw: Column, *cols: str) -> DataFrame:
    """One pseudo-random row per group: the one with the smallest draw."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*cols), draw).alias("r")).select(*by, "r.*")


def sampled_rows(df: DataFrame, n: int, draw: Column, tie: str) -> DataFrame:
    """n rows without replacement: the n smallest draws (take-ordered)."""
    return df.withColumn("_d", draw).orderBy("_d", tie).limit(n).drop("_d")
