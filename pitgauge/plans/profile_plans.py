"""Queries over daily series: climatology profiles, extremes, correlations, audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pitgauge.functions import physics as P
from pitgauge.functions import scoring as S
from pitgauge.operators import profile as PR
from pitgauge.operators import stats as ST
from pitgauge.operators import windows as W
from pitgauge.operators.quantiles import exact_quantiles, quantile_columns
from pitgauge.plans.panel_plans import _DAMAGE_SQL, damage_panel
from pitgauge.plans.registry import R, Rs, query, rounded
from pitgauge.plans.sql import LINEITEM_DAILY, ORDERS_DAILY, PANEL, band
from pitgauge.schemas import BANDS, ENUMS
from pitgauge.sources import adapters as A
from pitgauge.sources import readers as RD

HEAVY = 20.0


def _q(x: str, p: float, alias: str, digits: int = 4, cond: str = "") -> str:
    return R(f"quantile_cont({x}, {p}){cond}", digits, alias)


@query("integrity_profile", f"""WITH {ORDERS_DAILY} SELECT station_id, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day,
 count(*) FILTER (WHERE value IS NULL) AS n_null, count(day) - count(DISTINCT day) AS n_duplicate_days, count(*) FILTER (WHERE value < 0) AS n_negative,
 count(*) FILTER (WHERE value = 0) AS n_zero, count(*) FILTER (WHERE value > 0) AS n_wet,
 {R('avg(CASE WHEN value = 0 THEN 1e0 ELSE 0e0 END) * 100', alias='zero_pct')} FROM od GROUP BY station_id""")
def integrity_profile(spark, folder):
    out = PR.integrity_profile(A.orders_daily(spark, folder))
    return rounded(out, [c for c in out.columns if c != "zero_pct"], ["zero_pct"])


_DIST = ["p50", "p90", "p95", "p99", "max_value", "mean_value", "std_value"]


@query("distribution_profile", f"""WITH {ORDERS_DAILY}, r AS (SELECT 'all_days' AS pool, value FROM od UNION ALL SELECT 'wet_days', value FROM od WHERE value > 0
 UNION ALL SELECT 'sum_3d', CASE WHEN row_number() OVER w >= 3 THEN sum(value) OVER (ORDER BY day ROWS 2 PRECEDING) END FROM od WINDOW w AS (ORDER BY day)
 UNION ALL SELECT 'sum_7d', CASE WHEN row_number() OVER w >= 7 THEN sum(value) OVER (ORDER BY day ROWS 6 PRECEDING) END FROM od WINDOW w AS (ORDER BY day))
SELECT pool, count(value) AS n, {_q('value', 0.5, 'p50')}, {_q('value', 0.9, 'p90')}, {_q('value', 0.95, 'p95')}, {_q('value', 0.99, 'p99')},
 {R('max(value)', alias='max_value')}, {R('avg(value)', alias='mean_value')}, {R('stddev_pop(value)', alias='std_value')} FROM r GROUP BY pool""")
def distribution_profile(spark, folder):
    """All-day, wet-day and rolling distributions from one pass over the series."""
    rolled = PR.rolling_totals(A.orders_daily(spark, folder), (3, 7))
    pools = rolled.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("pool"), c.alias("value")) for n, c in [
            ("all_days", F.col("value")), ("wet_days", F.when(F.col("value") > 0, F.col("value"))),
            ("sum_3d", F.col("sum_3d")), ("sum_7d", F.col("sum_7d"))]])))
    return rounded(PR.distribution(pools, by=["pool"]), ["pool", "n"], _DIST)


@query("pooled_quantiles", f"""SELECT l_returnflag AS pool, count(*) AS n, {_q('l_extendedprice', 0.5, 'p50')}, {_q('l_extendedprice', 0.9, 'p90')},
 {_q('l_extendedprice', 0.99, 'p99')} FROM lineitem GROUP BY 1""")
def pooled_quantiles(spark, folder):
    """Exact quantiles of pools without a calendar bound."""
    rows = RD.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("pool"), "l_extendedprice")
    q = quantile_columns(exact_quantiles(rows, "l_extendedprice", [0.5, 0.9, 0.99], ["pool"]), ["pool"],
                         {0.5: "p50", 0.9: "p90", 0.99: "p99"})
    n = rows.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    return rounded(q.join(n, "pool"), ["pool", "n"], ["p50", "p90", "p99"])


_ANNUAL = f"""{ORDERS_DAILY}, an AS (SELECT station_id, CAST(year(day) AS INTEGER) AS year, sum(value) AS total, avg(value) AS daily_mean,
 count(*) FILTER (WHERE value > 0) AS wet_days, count(*) FILTER (WHERE value >= {HEAVY}) AS heavy_days, max(value) AS max_day, count(value) AS n_days FROM od GROUP BY 1, 2)"""


def _annual(spark, folder):
    return PR.annual_stats(A.orders_daily(spark, folder), HEAVY)


@query("annual_stats", f"WITH {_ANNUAL} SELECT station_id, year, wet_days, heavy_days, n_days, {Rs(['total', 'daily_mean', 'max_day'])} FROM an")
def annual_stats(spark, folder):
    return rounded(_annual(spark, folder), ["station_id", "year", "wet_days", "heavy_days", "n_days"], ["total", "daily_mean", "max_day"])


@query("annual_distribution", f"""WITH {_ANNUAL} SELECT station_id, count(total) AS n_years, {R('min(total)', alias='min_total')}, {_q('total', 0.25, 'p25')},
 {_q('total', 0.5, 'p50')}, {_q('total', 0.75, 'p75')}, {R('max(total)', alias='max_total')}, {R('avg(total)', alias='mean_total')},
 {R('stddev_pop(total)', alias='std_total')} FROM an GROUP BY station_id""")
def annual_distribution(spark, folder):
    return rounded(PR.annual_distribution(_annual(spark, folder)), ["station_id", "n_years"],
                   ["min_total", "p25", "p50", "p75", "max_total", "mean_total", "std_total"])


@query("annual_thresholds", f"""WITH {_ANNUAL} SELECT station_id, threshold, count(*) FILTER (WHERE total >= threshold) AS n_years,
 count(*) FILTER (WHERE max_day >= threshold) AS n_years_max_day FROM an, (SELECT unnest([50e0, 100e0, 1000e0, 3000e0, 4000e0]) AS threshold) GROUP BY 1, 2""")
def annual_thresholds(spark, folder):
    return PR.annual_threshold_counts(_annual(spark, folder), [50, 100, 1000, 3000, 4000])


@query("monthly_climatology", f"""WITH {ORDERS_DAILY} SELECT station_id, CAST(month(day) AS INTEGER) AS month, count(*) FILTER (WHERE value > 0) AS wet_days,
 {R('sum(value)', alias='total')}, {R('avg(value)', alias='daily_mean')}, {_q('value', 0.9, 'p90')}, {_q('value', 0.95, 'p95')}, {_q('value', 0.5, 'median_value')},
 {R('avg(CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END)', alias='wet_frequency')} FROM od GROUP BY 1, 2""")
def monthly_climatology(spark, folder):
    return rounded(PR.monthly_climatology(A.orders_daily(spark, folder)), ["station_id", "month", "wet_days"],
                   ["total", "daily_mean", "p90", "p95", "median_value", "wet_frequency"])


@query("seasonal_share", f"""WITH {ORDERS_DAILY} SELECT station_id, {R('sum(value)', alias='total')},
 {R('sum(CASE WHEN month(day) BETWEEN 10 AND 12 THEN value ELSE 0 END) / sum(value)', alias='share_oct_dec')},
 {R('sum(CASE WHEN month(day) = 11 THEN value ELSE 0 END) / sum(value)', alias='share_nov')} FROM od GROUP BY 1""")
def seasonal_share(spark, folder):
    return rounded(PR.seasonal_share(A.orders_daily(spark, folder)), ["station_id"], ["total", "share_oct_dec", "share_nov"])


@query("period_compare", f"""WITH {ORDERS_DAILY}, p AS (SELECT CAST(month(day) AS INTEGER) AS month, CASE WHEN year(day) BETWEEN 1995 AND 1997 THEN value END AS a,
 CASE WHEN year(day) BETWEEN 1998 AND 2001 THEN value END AS b FROM od)
SELECT month, {R('avg(a)', alias='mean_a')}, {R('avg(b)', alias='mean_b')}, {R('avg(b) - avg(a)', alias='mean_change')},
 {R('avg(CASE WHEN a > 0 THEN 1e0 WHEN a IS NOT NULL THEN 0e0 END)', alias='wet_a')}, {R('avg(CASE WHEN b > 0 THEN 1e0 WHEN b IS NOT NULL THEN 0e0 END)', alias='wet_b')} FROM p GROUP BY month""")
def period_compare(spark, folder):
    return rounded(PR.compare_periods(A.orders_daily(spark, folder), (1995, 1997), (1998, 2001)), ["month"],
                   ["mean_a", "mean_b", "mean_change", "wet_a", "wet_b"])


@query("top_extremes", f"WITH {ORDERS_DAILY} SELECT day, {R('value', 6)} FROM od ORDER BY od.value DESC, day LIMIT 20")
def top_extremes(spark, folder):
    return rounded(PR.top_days(A.orders_daily(spark, folder), 20), ["day"], ["value"], 6)


@query("ranked_extremes", f"""WITH {LINEITEM_DAILY} SELECT series, day, {R('value')}, CAST(row_number() OVER (PARTITION BY series ORDER BY ld.value DESC, day) AS INTEGER) AS rank
 FROM ld QUALIFY rank <= 10""")
def ranked_extremes(spark, folder):
    return rounded(PR.ranked_extremes(A.lineitem_daily(spark, folder), 10, ["series"]), ["series", "day", "rank"], ["value"])


@query("intensity_curve", f"""WITH {ORDERS_DAILY} SELECT station_id, day, {R('value', 6)}, CAST(row_number() OVER (PARTITION BY station_id ORDER BY od.value DESC, day) AS INTEGER) AS rank FROM od WHERE od.value > 0""")
def intensity_curve(spark, folder):
    return rounded(PR.intensity_curve(A.orders_daily(spark, folder)), ["station_id", "day", "rank"], ["value"], 6)


@query("top_event_share", f"""WITH {ORDERS_DAILY}, t AS (SELECT station_id, day, value, year(day) AS y FROM od ORDER BY value DESC, day LIMIT 1),
 y AS (SELECT year(day) AS y, sum(value) AS year_total FROM od GROUP BY 1)
SELECT station_id, day, {R('value', 6)}, {R('year_total')}, {R('value / year_total * 100', alias='share_pct')} FROM t JOIN y USING (y)""")
def top_event_share(spark, folder):
    out = PR.top_event_share(A.orders_daily(spark, folder))
    return out.select("station_id", "day", F.round("value", 6).alias("value"), F.round("year_total", 4).alias("year_total"),
                      F.round("share_pct", 4).alias("share_pct"))


@query("wet_dry_transitions", f"""WITH {LINEITEM_DAILY}, w AS (SELECT CAST(month(day) AS INTEGER) AS month, CASE WHEN value > 80 THEN 1e0 ELSE 0e0 END AS wet, series, day FROM ld),
 p AS (SELECT month, wet, lag(wet) OVER (PARTITION BY series ORDER BY day) AS prev FROM w)
SELECT month, count(*) AS n_days, {R('avg(wet)', alias='p_wet')}, {R('avg(wet) FILTER (WHERE prev = 1)', alias='p_wet_after_wet')},
 {R('avg(wet) FILTER (WHERE prev = 0)', alias='p_wet_after_dry')} FROM p GROUP BY month""")
def wet_dry_transitions(spark, folder):
    excess = A.lineitem_daily(spark, folder).withColumn("value", F.col("value") - 80.0)
    return rounded(PR.wet_dry_transitions(excess, ["series"]), ["month", "n_days"], ["p_wet", "p_wet_after_wet", "p_wet_after_dry"])


@query("wet_day_pools", f"""WITH {ORDERS_DAILY}, g AS (SELECT quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.9) AS q90 FROM od WHERE value > 0),
 m AS (SELECT CAST(month(day) AS INTEGER) AS month, count(*) AS n_days, count(*) FILTER (WHERE value > 0) AS n_wet, quantile_cont(value, 0.1) FILTER (WHERE value > 0) AS a,
  quantile_cont(value, 0.5) FILTER (WHERE value > 0) AS b, quantile_cont(value, 0.9) FILTER (WHERE value > 0) AS c FROM od GROUP BY 1)
SELECT month, n_days, n_wet, {R('CASE WHEN n_wet >= 65 THEN a ELSE q10 END', alias='q10')}, {R('CASE WHEN n_wet >= 65 THEN b ELSE q50 END', alias='q50')},
 {R('CASE WHEN n_wet >= 65 THEN c ELSE q90 END', alias='q90')} FROM m, g""")
def wet_day_pools(spark, folder):
    return rounded(PR.wet_day_pools(A.orders_daily(spark, folder), 65), ["month", "n_days", "n_wet"], ["q10", "q50", "q90"])


_SUMMARY = ["zero_pct", "mean_all", "p95_all", "mean_wet", "p50_wet", "p99_wet", "p99_3d", "max_7d"]
_PERIOD = f"""{LINEITEM_DAILY}, e AS (SELECT series, day, greatest(value - 80e0, 0e0) AS value FROM ld),
 r AS (SELECT *, CASE WHEN row_number() OVER w >= 3 THEN sum(value) OVER (PARTITION BY series ORDER BY day ROWS 2 PRECEDING) END AS s3,
  CASE WHEN row_number() OVER w >= 7 THEN sum(value) OVER (PARTITION BY series ORDER BY day ROWS 6 PRECEDING) END AS s7 FROM e WINDOW w AS (PARTITION BY series ORDER BY day)),
 ps AS (SELECT series, count(value) AS n, avg(CASE WHEN value = 0 THEN 1e0 ELSE 0e0 END) * 100 AS zero_pct, avg(value) AS mean_all, quantile_cont(value, 0.95) AS p95_all,
  avg(value) FILTER (WHERE value > 0) AS mean_wet, quantile_cont(value, 0.5) FILTER (WHERE value > 0) AS p50_wet, quantile_cont(value, 0.99) FILTER (WHERE value > 0) AS p99_wet,
  quantile_cont(s3, 0.99) AS p99_3d, max(s7) AS max_7d FROM r GROUP BY series)"""


def _summaries(spark, folder):
    excess = A.lineitem_daily(spark, folder).withColumn("value", F.greatest(F.col("value") - 80.0, F.lit(0.0)))
    return PR.period_summary(excess, ["series"])


@query("period_summary", f"WITH {_PERIOD} SELECT series, n, {Rs(_SUMMARY)} FROM ps")
def period_summary(spark, folder):
    return rounded(_summaries(spark, folder), ["series", "n"], _SUMMARY)


@query("multi_world_summary", f"WITH {_PERIOD} SELECT count(*) AS n_worlds, {', '.join(R(f'avg({m})', alias=m) for m in _SUMMARY)} FROM ps")
def multi_world_summary(spark, folder):
    return rounded(PR.across_worlds(_summaries(spark, folder), _SUMMARY), ["n_worlds"], _SUMMARY)


@query("grid_cell_series", """SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS value, count(*) AS n FROM lineitem
 WHERE l_suppkey % 10 = 3 AND l_partkey % 10 = 4 AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY 1""")
def grid_cell_series(spark, folder):
    """One cell of a long (day, lat, lon, value) grid within a range of years."""
    grid = RD.table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 10).cast("double").alias("lat"),
        (F.col("l_partkey") % 10).cast("double").alias("lon"), F.col("l_quantity").alias("value"))
    return RD.grid_cell(grid, 3.0, 4.0, 1996, 1998).groupBy("day").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))


@query("extract_integrity", """SELECT count(*) AS n_rows, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value,
 count(*) FILTER (WHERE l_extendedprice IS NULL) AS n_null FROM lineitem""")
def extract_integrity(spark, folder):
    return RD.integrity(RD.table(spark, folder, "lineitem"), "l_extendedprice")


@query("date_window_slice", f"""WITH {ORDERS_DAILY} SELECT day, {R('value', 6)} FROM od WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-01-31'""")
def date_window_slice(spark, folder):
    return rounded(A.orders_slice(spark, folder, "1996-01-01", "1996-01-31"), ["day"], ["value"], 6)


@query("template_provenance", f"""WITH {ORDERS_DAILY}, t AS (SELECT * FROM (VALUES ('wet_1996', DATE '1996-01-01', DATE '1996-01-31'), ('mid_1998', DATE '1998-05-10', DATE '1998-06-20'),
 ('late_2001', DATE '2001-07-15', DATE '2001-12-31')) v(template_id, first_day, last_day))
SELECT template_id, count(*) AS n_days, {R('sum(value)', 1, 'window_total')}, {R('max(value)', 1, 'window_max_day')} FROM t JOIN od ON day BETWEEN first_day AND last_day GROUP BY 1""")
def template_provenance(spark, folder):
    from pitgauge.operators.scenario import template_windows
    t = spark.createDataFrame(
        [("wet_1996", dt.date(1996, 1, 1), dt.date(1996, 1, 31)), ("mid_1998", dt.date(1998, 5, 10), dt.date(1998, 6, 20)),
         ("late_2001", dt.date(2001, 7, 15), dt.date(2001, 12, 31))], "template_id string, first_day date, last_day date")
    return rounded(template_windows(A.orders_daily(spark, folder), t), ["template_id", "n_days"], ["window_total", "window_max_day"], 1)


@query("event_accumulations", f"""WITH {ORDERS_DAILY}, e AS (SELECT CAST(row_number() OVER (ORDER BY value DESC, day) AS INTEGER) AS event_id, day AS event_day FROM od QUALIFY event_id <= 15)
SELECT event_id, event_day, {R('coalesce(sum(value) FILTER (WHERE day = event_day), 0)', alias='sum_1d')}, {R('coalesce(sum(value) FILTER (WHERE day BETWEEN event_day - 2 AND event_day), 0)', alias='sum_3d')},
 {R('coalesce(sum(value) FILTER (WHERE day BETWEEN event_day - 6 AND event_day), 0)', alias='sum_7d')}, count(*) FILTER (WHERE day <= event_day) AS days_in_7d,
 count(*) AS excerpt_days, {R('max(value)', alias='excerpt_max')} FROM e JOIN od ON day BETWEEN event_day - 6 AND event_day + 6 GROUP BY 1, 2""")
def event_accumulations(spark, folder):
    series = A.orders_daily(spark, folder)
    events = PR.ranked_extremes(series, 15, ["station_id"]).select(F.col("rank").alias("event_id"), F.col("day").alias("event_day"))
    return rounded(PR.event_accumulations(series, events), ["event_id", "event_day", "days_in_7d", "excerpt_days"],
                   ["sum_1d", "sum_3d", "sum_7d", "excerpt_max"])


@query("histogram", f"""WITH {ORDERS_DAILY}, b AS (SELECT quantile_cont(value, 0.999) AS hi FROM od)
SELECT CAST(least(floor(value / (hi / 80)), 79) AS INTEGER) AS bin, count(*) AS n FROM od, b WHERE value BETWEEN 0 AND hi GROUP BY 1""")
def histogram(spark, folder):
    """80 bins from 0 to the 99.9th percentile."""
    series = A.orders_daily(spark, folder)
    hi = exact_quantiles(series, "value", [0.999]).select("quantile").scalar()
    return PR.histogram(series, "value", 0.0, hi, 80)


@query("binned_means", """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(greatest(ceil((l_extendedprice - lo) / ((hi - lo) / 12)), 1), 12) AS INTEGER) AS bin, count(*) AS n, round(avg(l_quantity), 4) AS mean_y FROM lineitem, b GROUP BY 1""")
def binned_means(spark, folder):
    return rounded(PR.binned_mean(RD.table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", 12), ["bin", "n"], ["mean_y"])


@query("rounded_buckets", """SELECT round(l_discount, 1) AS bucket, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_y FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 8""")
def rounded_buckets(spark, folder):
    return rounded(PR.rounded_buckets(RD.table(spark, folder, "lineitem"), "l_discount", "l_extendedprice"), ["n"], ["bucket", "mean_y"])


@query("stratified_means", """SELECT l_returnflag, l_linestatus, l_linenumber, l_discount >= 0.05 AS deep_discount, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_y FROM lineitem GROUP BY ALL""")
def stratified_means(spark, folder):
    rows = RD.table(spark, folder, "lineitem").withColumn("deep_discount", F.col("l_discount") >= 0.05)
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "deep_discount"]
    return rounded(ST.stratified(rows, keys, "l_extendedprice"), [*keys, "n"], ["mean_y"])


@query("wet_dry_contrast", f"""WITH {PANEL} SELECT seed, {R('quantile_cont(groundwater_proxy, 0.5) FILTER (WHERE wet_day)', alias='median_wet')},
 {R('quantile_cont(groundwater_proxy, 0.5) FILTER (WHERE NOT wet_day)', alias='median_dry')} FROM panel GROUP BY seed""")
def wet_dry_contrast(spark, folder):
    return rounded(PR.wet_dry_contrast(A.events_panel(spark, folder), "groundwater_proxy", "wet_day", ["seed"]), ["seed"], ["median_wet", "median_dry"])


@query("group_corr", f"WITH {PANEL} SELECT seed, count(*) AS n, {R('corr(groundwater_proxy, score)', alias='corr_xy')} FROM panel GROUP BY seed")
def group_corr(spark, folder):
    return rounded(ST.group_correlation(A.events_panel(spark, folder), "groundwater_proxy", "score", ["seed"]), ["seed", "n"], ["corr_xy"])


@query("mean_group_corr", f"""WITH {PANEL}, c AS (SELECT zone_id, corr(rainfall_mm, score) AS c FROM panel GROUP BY zone_id)
SELECT count(c) AS n_groups, {R('avg(c)', alias='mean_corr')} FROM c""")
def mean_group_corr(spark, folder):
    return rounded(ST.mean_group_correlation(A.events_panel(spark, folder), "rainfall_mm", "score", ["zone_id"]), ["n_groups"], ["mean_corr"])


@query("partial_corr", f"""WITH {PANEL}, s AS (SELECT seed, rainfall_mm AS x, score AS y, groundwater_proxy AS u, crack_density AS v FROM panel),
 q AS (SELECT seed, sum(x*u) xu, sum(x*v) xv, sum(y*u) yu, sum(y*v) yv, sum(u*u) uu, sum(u*v) uv, sum(v*v) vv FROM s GROUP BY seed),
 r AS (SELECT seed, x - (xu*vv - xv*uv)/(uu*vv - uv*uv)*u - (xv*uu - xu*uv)/(uu*vv - uv*uv)*v AS rx, y - (yu*vv - yv*uv)/(uu*vv - uv*uv)*u - (yv*uu - yu*uv)/(uu*vv - uv*uv)*v AS ry
  FROM s JOIN q USING (seed))
SELECT seed, count(*) AS n, {R('corr(rx, ry)', alias='partial_corr')} FROM r GROUP BY seed""")
def partial_corr(spark, folder):
    out = ST.partial_correlation(A.events_panel(spark, folder), "rainfall_mm", "score", "groundwater_proxy", "crack_density", ["seed"])
    return rounded(out, ["seed", "n"], ["partial_corr"])


@query("lag_corr", f"WITH {PANEL}, l AS (SELECT seed, lag_days, score, CASE lag_days WHEN 0 THEN rainfall_mm WHEN 1 THEN l1 WHEN 3 THEN l3 ELSE l7 END AS x FROM "
       "(SELECT *, lag(rainfall_mm, 1) OVER w AS l1, lag(rainfall_mm, 3) OVER w AS l3, lag(rainfall_mm, 7) OVER w AS l7 FROM panel WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx)), "
       f"(SELECT CAST(unnest([0, 1, 3, 7]) AS INTEGER) AS lag_days)) SELECT seed, lag_days, {R('corr(x, score)', alias='corr_xy')} FROM l GROUP BY seed, lag_days")
def lag_corr(spark, folder):
    return rounded(ST.lagged_correlation(A.events_panel(spark, folder), "rainfall_mm", "score", [0, 1, 3, 7], by=["seed"]), ["seed", "lag_days"], ["corr_xy"])


_BAND_COLS = ["n_" + b.lower().replace(" ", "_") for b in BANDS]


@query("label_pivot", f"WITH {PANEL} SELECT seed, " + ", ".join(f"count(*) FILTER (WHERE {band('score')} = '{b}') AS {c}" for b, c in zip(BANDS, _BAND_COLS)) + " FROM panel GROUP BY seed")
def label_pivot(spark, folder):
    return ST.pivot_counts(A.events_panel(spark, folder).withColumn("band", S.score_band("score")), "seed", "band", BANDS)


@query("family_contingency", _DAMAGE_SQL + " SELECT zc AS zone_code, " + ", ".join(
    f"count(*) FILTER (WHERE crack_family = '{v}') AS n_{v}" for v in ENUMS["crack_family"]) + " FROM damage GROUP BY zc")
def family_contingency(spark, folder):
    return ST.pivot_counts(damage_panel(spark, folder), "zone_code", "crack_family", ENUMS["crack_family"])


_AUDIT = _DAMAGE_SQL + """, a AS (SELECT zc AS zone_code, seed, zone_id, arg_max(depth_m, day_idx) AS final_depth, max(growth_mm) AS max_growth,
 count(*) FILTER (WHERE growth_mm > 2) AS acute_days, avg(CASE WHEN growth_mm > 2 THEN 1e0 ELSE 0e0 END) AS acute_share, max(depth_m) AS max_depth,
 max(CASE WHEN depth_m >= 0.3 - 1e-9 THEN 1 ELSE 0 END) AS hit_cap, min(CASE WHEN depth_m >= 0.3 - 1e-9 THEN day_idx END) - min(day_idx) AS days_to_cap FROM damage GROUP BY ALL)"""


def _audits(spark, folder):
    return ST.series_audit(damage_panel(spark, folder), "depth_m", 0.3, "growth_mm", 2.0, ["zone_code", "seed", "zone_id"])


@query("time_to_threshold", _AUDIT + f" SELECT zone_code, seed, zone_id, CAST(hit_cap AS INTEGER) AS hit_cap, CAST(days_to_cap AS INTEGER) AS days_to_cap, acute_days, {Rs(['final_depth', 'max_depth', 'max_growth', 'acute_share'])} FROM a")
def time_to_threshold(spark, folder):
    return rounded(_audits(spark, folder), ["zone_code", "seed", "zone_id", "hit_cap", "days_to_cap", "acute_days"],
                   ["final_depth", "max_depth", "max_growth", "acute_share"])


@query("two_level_audit", _AUDIT + f""" SELECT zone_code, count(*) AS n_series, {_q('final_depth', 0.5, 'depth_p50')}, {_q('final_depth', 0.9, 'depth_p90')}, {R('avg(hit_cap)', alias='cap_rate')},
 {_q('days_to_cap', 0.5, 'days_to_cap_p50')}, {R('max(max_growth)', alias='max_growth')}, CAST(sum(acute_days) AS BIGINT) AS acute_days FROM a GROUP BY zone_code""")
def two_level_audit(spark, folder):
    return rounded(ST.audit_across_worlds(_audits(spark, folder), ["zone_code"]), ["zone_code", "n_series", "acute_days"],
                   ["depth_p50", "depth_p90", "cap_rate", "days_to_cap_p50", "max_growth"])


@query("exceedance_counts", f"""WITH {PANEL}, z AS (SELECT seed, count(*) FILTER (WHERE score >= 75) AS n FROM panel GROUP BY seed)
SELECT seed, n AS n_exceed, n > 0 AS any_exceed FROM z""")
def exceedance_counts(spark, folder):
    return A.events_panel(spark, folder).groupBy("seed").agg(F.count_if(F.col("score") >= 75).alias("n_exceed")).withColumn("any_exceed", F.col("n_exceed") > 0)


@query("category_mode", _DAMAGE_SQL + """, c AS (SELECT zc AS zone_code, crack_family, count(*) AS n FROM damage GROUP BY 1, 2)
SELECT zone_code, crack_family AS mode_value, n AS mode_count FROM c QUALIFY row_number() OVER (PARTITION BY zone_code ORDER BY n DESC, crack_family) = 1""")
def category_mode(spark, folder):
    return ST.most_frequent(damage_panel(spark, folder), "crack_family", ["zone_code"])


_SEV = "list_position(['normal','minor','moderate','severe','critical'], crack_severity)"


@query("observed_states", _DAMAGE_SQL + f""", l AS (SELECT DISTINCT zc, crack_severity, {_SEV} AS o FROM damage),
 lv AS (SELECT *, row_number() OVER (PARTITION BY zc ORDER BY o DESC) AS rn FROM l),
 st AS (SELECT zc, max(density) AS mx, quantile_cont(density, 0.95) AS p95, avg(density) FILTER (WHERE blast_occurs) AS me, avg(density) FILTER (WHERE NOT blast_occurs) AS mo FROM damage GROUP BY zc)
SELECT st.zc AS zone_code, {R('mx', alias='max_value')}, {R('p95', alias='p95_value')}, {R('me', alias='mean_event')}, {R('mo', alias='mean_other')},
 (SELECT crack_severity FROM lv WHERE lv.zc = st.zc AND rn = 1) AS worst_level, (SELECT crack_severity FROM lv WHERE lv.zc = st.zc AND rn = 2) AS second_worst_level FROM st""")
def observed_states(spark, folder):
    """Observed crack state per zone: maximum, p95, event contrast and the two worst levels."""
    d = damage_panel(spark, folder).select("zone_code", "density", "blast_occurs", "crack_severity")
    p95 = exact_quantiles(d, "density", [0.95], ["zone_code"]).select("zone_code", F.col("quantile").alias("p95_value"))
    out = (ST.event_contrast(d, "density", "blast_occurs", ["zone_code"]).join(p95, "zone_code")
           .join(ST.level_extremes(d, "crack_severity", S.ordinal("crack_severity", "crack_severity"), ["zone_code"]), "zone_code"))
    return rounded(out, ["zone_code", "worst_level", "second_worst_level"], ["max_value", "p95_value", "mean_event", "mean_other"])


_FOSL = "SELECT *, 2.5e0 - score / 50e0 AS fos FROM panel"
_LAB = "CASE WHEN fos < 0.8 THEN 'critical' WHEN fos < 1.0 THEN 'high' WHEN fos < 1.2 THEN 'moderate' WHEN fos < 1.5 THEN 'low' ELSE 'very_low' END"


@query("fos_label_ranges", f"""WITH {PANEL}, f AS ({_FOSL}), g AS (SELECT *, {_LAB} AS lab, list_position(['very_low','low','moderate','high','critical'], {_LAB}) AS o FROM f)
SELECT zone_id, seed, count(DISTINCT lab) AS n_labels, arg_min(lab, o) AS best_label, arg_max(lab, o) AS worst_label, {R('min(fos)', alias='min_value')},
 {R('max(fos)', alias='max_value')}, {R('quantile_cont(fos, 0.5)', alias='median_value')} FROM g GROUP BY zone_id, seed""")
def fos_label_ranges(spark, folder):
    """Labels and factor-of-safety range per zone and world."""
    f = A.events_panel(spark, folder).withColumn("fos", 2.5 - F.col("score") / 50.0).withColumn("lab", P.risk_label("fos"))
    span = ST.level_span(f, "lab", S.ordinal("lab", "risk_label"), "fos", ["zone_id", "seed"])
    med = f.groupBy("zone_id", "seed").agg(F.percentile("fos", F.lit(0.5)).alias("median_value"))
    return rounded(span.join(med, ["zone_id", "seed"]), ["zone_id", "seed", "n_labels", "best_label", "worst_label"],
                   ["min_value", "max_value", "median_value"])


@query("trajectory_measures", f"""WITH {PANEL} SELECT seed, zone_id, min(CASE WHEN score >= 60 THEN day_idx END) AS first_day, count(*) FILTER (WHERE score >= 60) AS n_days,
 {R('max(score)', alias='peak')}, (array_agg(day_idx ORDER BY score DESC, day_idx))[1] AS peak_day FROM panel GROUP BY seed, zone_id""")
def trajectory_measures(spark, folder):
    return rounded(ST.threshold_measures(A.events_panel(spark, folder), "score", 60, ["seed", "zone_id"]),
                   ["seed", "zone_id", "first_day", "n_days", "peak_day"], ["peak"])


@query("static_columns", f"""WITH {PANEL} SELECT seed, min(zone_id % 5) = max(zone_id % 5) AS world_static, min(rainfall_mm) = max(rainfall_mm) AS rainfall_mm_static FROM panel GROUP BY seed""")
def static_columns(spark, folder):
    p = A.events_panel(spark, folder).withColumn("world", F.col("zone_id") % 5)
    return ST.static_columns(p, ["world", "rainfall_mm"], ["seed"])


@query("cumulative_growth", f"""WITH {PANEL}, g AS (SELECT seed, zone_id, greatest(crack_density - lag(crack_density) OVER w, 0e0) AS g FROM panel WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx))
SELECT seed, zone_id, {R('coalesce(sum(g), 0)', alias='total_growth')} FROM g GROUP BY seed, zone_id""")
def cumulative_growth(spark, folder):
    return rounded(ST.positive_growth(A.events_panel(spark, folder), "crack_density"), ["seed", "zone_id"], ["total_growth"])


@query("closest_to_median", f"""WITH {PANEL}, m AS (SELECT zone_id, quantile_cont(score, 0.5) AS med FROM panel GROUP BY zone_id)
SELECT zone_id, {R('med', alias='median_x')}, day_idx, {R('score')} FROM panel JOIN m USING (zone_id) QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY round(abs(panel.score - med), 9), day_idx) = 1""")
def closest_to_median(spark, folder):
    return rounded(ST.closest_to_median(A.events_panel(spark, folder), "score", ["zone_id"], "day_idx"), ["zone_id", "day_idx"], ["median_x", "score"])


@query("sampled_base_rows", f"""WITH {PANEL}, d AS (SELECT *, (zone_id * 7919 + day_idx * 104729 + 17) % 1000003 AS draw FROM panel)
SELECT zone_id, day_idx, {R('score')} FROM d QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY draw, day_idx) = 1""")
def sampled_base_rows(spark, folder):
    """One repeatable random row per zone."""
    draw = F.pmod(F.col("zone_id") * 7919 + F.col("day_idx") * 104729 + 17, F.lit(1000003))
    return rounded(ST.sampled_row(A.events_panel(spark, folder), ["zone_id"], F.struct(draw, "day_idx"), "day_idx", "score"), ["zone_id", "day_idx"], ["score"])


@query("sampled_rows", f"""WITH {PANEL} SELECT zone_id, day_idx, {R('score')} FROM panel ORDER BY (zone_id * 7919 + day_idx * 104729 + 23) % 1000003, zone_id, day_idx LIMIT 50""")
def sampled_rows(spark, folder):
    """Fifty rows without replacement (the sampling operator)."""
    draw = F.pmod(F.col("zone_id") * 7919 + F.col("day_idx") * 104729 + 23, F.lit(1000003))
    out = ST.sampled_rows(A.events_panel(spark, folder), 50, F.struct(draw, "zone_id"), "day_idx")
    return rounded(out, ["zone_id", "day_idx"], ["score"])


@query("distribution_vs_history", f"""WITH {PANEL}, {ORDERS_DAILY}, h AS (SELECT avg(value) AS hm, quantile_cont(value, 0.95) AS hp FROM od WHERE value > 0),
 g AS (SELECT seed, avg(rainfall_mm) FILTER (WHERE wet_day) AS gm, quantile_cont(rainfall_mm, 0.95) FILTER (WHERE wet_day) AS gp FROM panel GROUP BY seed)
SELECT seed, {R('gm', alias='mean_wet')}, {R('hm', alias='hist_mean_wet')}, {R('gm / hm', alias='mean_ratio')}, {R('gp / hp', alias='p95_ratio')}, gm / hm BETWEEN 0.5 AND 2 AS within_band FROM g, h""")
def distribution_vs_history(spark, folder):
    """Wet-day statistics per world against those of the historical series."""
    wet = A.events_panel(spark, folder).where("wet_day")
    hist = A.orders_daily(spark, folder).where("value > 0")
    hm = hist.agg(F.avg("value")).scalar()
    hp = exact_quantiles(hist, "value", [0.95]).select("quantile").scalar()
    p95 = exact_quantiles(wet, "rainfall_mm", [0.95], ["seed"]).select("seed", F.col("quantile").alias("p95"))
    g = wet.groupBy("seed").agg(F.avg("rainfall_mm").alias("mean_wet")).join(p95, "seed")
    out = g.select("seed", "mean_wet", hm.alias("hist_mean_wet"), (F.col("p95") / hp).alias("p95_ratio")).withColumn(
        "mean_ratio", F.col("mean_wet") / F.col("hist_mean_wet")).withColumn("within_band", F.col("mean_ratio").between(0.5, 2.0))
    return rounded(out, ["seed", "within_band"], ["mean_wet", "hist_mean_wet", "mean_ratio", "p95_ratio"])
