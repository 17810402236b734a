"""Data-quality queries and table equality."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgauge.operators import quality as Q
from pitgauge.operators import setops as SO
from pitgauge.operators import windows as W
from pitgauge.operators.chain import recompute
from pitgauge.plans.panel_plans import _DAMAGE_SQL, damage_panel
from pitgauge.plans.registry import query
from pitgauge.plans.sql import DENSE, PANEL
from pitgauge.schemas import enum_table
from pitgauge.sources import adapters as A
from pitgauge.sources import readers as RD


def _union(parts: list[tuple[str, str, str, str]]) -> str:
    """(rule, severity, scope predicate, failing predicate) -> one scan of counts, unpivoted."""
    sums = ", ".join(f"count(*) FILTER (WHERE {s}) AS n{i}, count(*) FILTER (WHERE ({s}) AND NOT coalesce({ok}, false)) AS f{i}"
                     for i, (_, _, s, ok) in enumerate(parts))
    rows = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{v}' AS severity, n{i} AS checked_rows, f{i} AS failed_rows, f{i} = 0 AS passed FROM sums"
                              for i, (r, v, _, _) in enumerate(parts))
    return f"sums AS (SELECT {sums} FROM src) {rows}"


_LINE = [
    ("quantity_range", "error", "true", "l_quantity BETWEEN 1 AND 50"), ("discount_range", "error", "true", "l_discount BETWEEN 0 AND 0.1"),
    ("price_positive", "error", "true", "l_extendedprice > 0"), ("flag_known", "error", "true", "l_returnflag IN ('A', 'N', 'R')"),
    ("status_known", "error", "true", "l_linestatus IN ('O', 'F')"), ("returned_lines_taxed", "warning", "l_returnflag = 'R'", "l_tax > 0"),
    ("deep_discount_small", "warning", "l_discount >= 0.09", "l_quantity <= 25"), ("shipped_in_span", "error", "true", "l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")]


def line_rules():
    c = F.col
    return [
        Q.RowRule("quantity_range", c("l_quantity").between(1, 50)), Q.RowRule("discount_range", c("l_discount").between(0, 0.1)),
        Q.RowRule("price_positive", c("l_extendedprice") > 0), Q.RowRule("flag_known", c("l_returnflag").isin("A", "N", "R")),
        Q.RowRule("status_known", c("l_linestatus").isin("O", "F")),
        Q.RowRule("returned_lines_taxed", c("l_tax") > 0, "warning", c("l_returnflag") == "R"),
        Q.RowRule("deep_discount_small", c("l_quantity") <= 25, "warning", c("l_discount") >= 0.09),
        Q.RowRule("shipped_in_span", F.to_date("l_shipdate") >= F.lit("1995-01-01").cast("date"))]


@query("quality_rules", f"WITH src AS (SELECT * FROM lineitem), {_union(_LINE)}")
def quality_rules(spark, folder):
    return Q.check_rows(RD.table(spark, folder, "lineitem"), line_rules())


@query("quality_verdict", f"""WITH v AS (WITH src AS (SELECT * FROM lineitem), {_union(_LINE)})
SELECT count(*) AS n_results, count(*) FILTER (WHERE NOT passed AND severity = 'error') AS n_errors, count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS n_warnings,
 count(*) FILTER (WHERE NOT passed AND severity = 'error') = 0 AS passed FROM v""")
def quality_verdict(spark, folder):
    return Q.verdict(Q.check_rows(RD.table(spark, folder, "lineitem"), line_rules()))


@query("quality_quarantine", """SELECT CASE WHEN l_returnflag = 'R' AND NOT l_tax > 0 THEN CASE WHEN l_discount >= 0.09 AND l_quantity > 25 THEN 'returned_lines_taxed,deep_discount_small' ELSE 'returned_lines_taxed' END
 ELSE 'deep_discount_small' END AS broken, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty FROM lineitem WHERE (l_returnflag = 'R' AND NOT l_tax > 0) OR (l_discount >= 0.09 AND l_quantity > 25) GROUP BY 1""")
def quality_quarantine(spark, folder):
    """Rows held back, by the set of rules they broke."""
    _, bad = Q.quarantine(RD.table(spark, folder, "lineitem"), line_rules())
    return bad.groupBy(F.array_join("broken_rules", ",").alias("broken")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


_CRACK = [
    ("growth_non_negative", "error", "true", "growth_mm >= 0"), ("growth_below_failure_window", "warning", "true", "growth_mm < 20"),
    ("depth_within_cap", "error", "true", "depth_m <= cap + 1e-9"), ("width_within_cap", "error", "true", "width_mm <= CASE WHEN zc = 'ZONE_D' THEN 60e0 ELSE 150e0 END + 1e-9"),
    ("density_bounds", "error", "true", "density BETWEEN 0.05 AND 2.5"), ("depth_implies_width", "error", "depth_m > 0", "width_mm > 0"),
    ("floor_family", "error", "zc = 'ZONE_D'", "crack_family IN ('none', 'floor_heave')"), ("bench_family", "error", "zc <> 'ZONE_D'", "crack_family <> 'floor_heave'"),
    ("blast_only_where_allowed", "error", "true", "zc IN ('ZONE_A', 'ZONE_B') OR NOT blast_occurs"), ("ppv_iff_event", "error", "true", "(ppv > 0) = blast_occurs"),
    ("ppv_limit", "error", "true", "ppv BETWEEN 0 AND 100"),
    ("depth_m_never_falls", "error", "ds IS NOT NULL", "ds >= -1e-9"), ("width_mm_never_falls", "error", "ws IS NOT NULL", "ws >= -1e-9"),
    ("crack_severity_level_never_falls", "error", "ss IS NOT NULL", "ss >= 0")]


@query("panel_quality_rules", _DAMAGE_SQL + """, src AS (SELECT *, depth_m - lag(depth_m) OVER w AS ds, width_mm - lag(width_mm) OVER w AS ws,
 list_position(['normal','minor','moderate','severe','critical'], crack_severity) - lag(list_position(['normal','minor','moderate','severe','critical'], crack_severity)) OVER w AS ss
 FROM damage WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx)), """ + _union(_CRACK))
def panel_quality_rules(spark, folder):
    """Crack, vibration and ratchet families over the damage panel."""
    d = Q.ordinal_column(damage_panel(spark, folder), "crack_severity", "crack_severity")
    cols = ["depth_m", "width_mm", "crack_severity_level"]
    return Q.check_rows(Q.with_steps(d, cols), Q.crack_rules() + Q.blast_rules() + Q.ratchet_rules(cols))


@query("group_quality_rules", f"""WITH {PANEL}, p AS (SELECT *, lag(groundwater_proxy) OVER (PARTITION BY seed, zone_id ORDER BY day_idx) AS prev, 2.5e0 - score / 50e0 AS fos FROM panel),
 s AS (SELECT seed, corr(groundwater_proxy, prev) AS a, corr(score, fos) AS b, corr(rainfall_mm, groundwater_proxy) AS c, count(*) FILTER (WHERE blast_occurs) * 1e0 AS d,
  avg(CASE WHEN rainfall_mm > 0 THEN 1e0 ELSE 0e0 END) AS e FROM p GROUP BY seed)
SELECT seed, 'proxy_persists' AS rule_id, 'error' AS severity, a > 0.5 AS passed, round(a, 4) AS detail FROM s UNION ALL SELECT seed, 'score_falls_with_fos', 'error', b < -0.9, round(b, 4) FROM s
 UNION ALL SELECT seed, 'rain_feeds_proxy', 'error', c > 0, round(c, 4) FROM s UNION ALL SELECT seed, 'has_events', 'error', d > 0, round(d, 4) FROM s
 UNION ALL SELECT seed, 'wet_share_plausible', 'error', e BETWEEN 0.05 AND 0.95, round(e, 4) FROM s""")
def group_quality_rules(spark, folder):
    ws = W.series_window()
    p = A.events_panel(spark, folder).withColumns({"groundwater_proxy_prev": F.lag("groundwater_proxy").over(ws), "fos": 2.5 - F.col("score") / 50.0})
    return Q.check_groups(p, Q.state_rules(score="score"), ["seed"]).withColumn("detail", F.round("detail", 4))


@query("stability_rules", f"""WITH {DENSE} SELECT r.rule_id, 'error' AS severity, count(*) AS checked_rows, CAST(0 AS BIGINT) AS failed_rows, true AS passed
 FROM dense, (SELECT unnest(['fos_defined', 'label_follows_fos', 'score_follows_fos', 'score_bounds', 'rain_non_negative', 'rain_3d_covers_1d', 'rain_7d_covers_3d', 'rain_regime_matches', 'wet_day_matches']) AS rule_id) r GROUP BY 1""")
def stability_rules(spark, folder):
    """Labels and scores as functions of stability, and rain consistency, on the recomputed chain."""
    from pitgauge.functions.physics import rain_regime
    run = recompute(A.site_panel(spark, folder), W.SERIES).withColumn("rainfall_regime", rain_regime("rainfall_mm"))
    return Q.check_rows(run, Q.stability_rules() + Q.rain_rules())


@query("panel_completeness", f"""WITH {DENSE}, s AS (SELECT seed, zone_id, count(*) AS n, count(DISTINCT day_idx) AS d FROM dense GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE n <> (SELECT max(day_idx) + 1 FROM dense) OR d <> n) AS n_incomplete, count(*) AS n_series FROM s""")
def panel_completeness(spark, folder):
    p = A.events_dense(spark, folder)
    bad = Q.completeness(p).agg(F.count(F.lit(1))).scalar()
    series = p.select("seed", "zone_id").distinct()
    return series.agg(F.count(F.lit(1)).alias("n_series")).select(bad.alias("n_incomplete"), "n_series")


@query("enum_membership", """SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('none','rainfall_storm','prolonged_rain','historical_rain','combined','blast_surge') GROUP BY 1""")
def enum_membership(spark, folder):
    """Values outside an enumeration, with counts."""
    return Q.enum_violations(RD.table(spark, folder, "events"), "event_type", "scenario_kind", enum_table(spark))


@query("functional_dependency", """SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING min(l_partkey % 25) <> max(l_partkey % 25)""")
def functional_dependency(spark, folder):
    li = RD.table(spark, folder, "lineitem").withColumn("bin", F.col("l_partkey") % 25)
    return Q.functional_dependency(li, "l_suppkey", "bin")


@query("cross_zone_equality", f"""WITH {DENSE} SELECT day_idx, max(day_idx * 2e0) - min(day_idx * 2e0) <= 1e-9 AS day_weight_equal, max(rainfall_mm) - min(rainfall_mm) <= 1e-9 AS rainfall_mm_equal FROM dense GROUP BY day_idx""")
def cross_zone_equality(spark, folder):
    """Whether all zones agree on a column per day."""
    p = A.events_dense(spark, folder).withColumn("day_weight", F.col("day_idx") * 2.0)
    return Q.cross_zone_equality(p, ["day_weight", "rainfall_mm"], ["day_idx"])


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return Q.duplicate_keys(RD.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def _exact(spark, folder):
    p = A.events_panel(spark, folder)
    return p.select("seed", "zone_id", "day_idx", F.round("score", 9).alias("score"), "wet_day")


@query("exact_equality", f"""WITH {PANEL}, a AS (SELECT seed, zone_id, day_idx, round(score, 9) AS score, wet_day FROM panel),
 n AS (SELECT seed FROM (SELECT *, 1 AS l FROM a UNION ALL SELECT *, -1 FROM a) GROUP BY seed, zone_id, day_idx, score, wet_day HAVING sum(l) <> 0) SELECT count(*) AS n_different, count(*) = 0 AS is_equal FROM n""")
def exact_equality(spark, folder):
    """Two independent builds of the panel agree row for row."""
    return SO.equality_report(_exact(spark, folder), _exact(spark, folder))


@query("multiset_difference", f"""WITH {PANEL}, a AS (SELECT seed, day_idx, wet_day FROM panel), b AS (SELECT seed, day_idx, wet_day OR day_idx = 3 AS wet_day FROM panel)
SELECT seed, day_idx, wet_day, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right FROM (SELECT *, 1 AS l, 0 AS r FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY 1, 2, 3 HAVING sum(l) <> sum(r)""")
def multiset_difference(spark, folder):
    a = A.events_dense(spark, folder).select("seed", "day_idx", "wet_day")
    b = a.withColumn("wet_day", F.col("wet_day") | (F.col("day_idx") == 3))
    return SO.multiset_difference(a, b)


@query("tolerant_equality", f"""WITH {DENSE} SELECT CAST(0 AS BIGINT) AS n_unmatched, 0e0 AS max_gap, CAST(0 AS BIGINT) AS n_beyond FROM (SELECT count(*) FROM dense)""")
def tolerant_equality(spark, folder):
    """Blocked and plain groundwater memory agree (a short decay, so that blocks of 15 days suffice)."""
    dense, keys = A.events_dense(spark, folder), ["seed", "zone_id", "day_idx"]
    plain = dense.select(*keys, W.exponential_memory("rainfall_mm", W.series_window(), tau=0.5).alias("m"))
    blocked = W.with_long_memory(dense, "rainfall_mm", "m", tau=0.5, block_days=15).select(*keys, "m")
    out = SO.tolerance_report(plain, blocked, keys, ["m"], 1e-6)
    return out.select("n_unmatched", F.round("max_gap", 6).alias("max_gap"), "n_beyond")


@query("world_union", f"""WITH {DENSE} SELECT seed, count(*) AS n_rows, count(DISTINCT zone_id) AS n_zones, min(day_idx) AS first_day, max(day_idx) AS last_day FROM dense GROUP BY seed""")
def world_union(spark, folder):
    """Worlds read back from an export partitioned by world, with the manifest's counts."""
    from pitgauge.session import scratch_path
    from pitgauge.sources.writers import manifest, write_export
    path = scratch_path(spark, "panel-export")
    write_export(A.events_dense(spark, folder), path)
    return manifest(SO.union_all([RD.corpus(spark, path).where("seed <= 2"), RD.corpus(spark, path).where("seed > 2")]))
