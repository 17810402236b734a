"""Evaluation queries: regression and class metrics, bootstrap, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgauge.operators import evaluation as E
from pitgauge.plans.registry import R, Rs, query, rounded
from pitgauge.plans.sql import PANEL
from pitgauge.sources import adapters as A

_PAIRS = "pr AS (SELECT l_suppkey % 10 AS world, l_extendedprice AS y, l_quantity * 1500e0 AS p FROM lineitem)"
_M = (f"{R('avg(abs(y - p))', alias='mae')}, {R('sqrt(avg((y - p) * (y - p)))', alias='rmse')}, "
      f"{R('1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*))', alias='r2')}")


@query("reg_metrics", f"WITH {_PAIRS} SELECT world, count(*) AS n, {_M} FROM pr GROUP BY world")
def reg_metrics(spark, folder):
    return rounded(E.regression_metrics(A.price_pairs(spark, folder), ["world"]), ["world", "n"], ["mae", "rmse", "r2"])


@query("reg_metrics_total", f"WITH {_PAIRS} SELECT count(*) AS n, {_M} FROM pr")
def reg_metrics_total(spark, folder):
    """Totals from the sums of the worlds: the sums add up, nothing is rescanned."""
    sums = E.error_sums(A.price_pairs(spark, folder), ["world"])
    total = sums.agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy", "see", "sae")])
    return rounded(E.metrics_from_sums(total, []), ["n"], ["mae", "rmse", "r2"])


@query("cluster_bootstrap", f"""WITH {_PAIRS}, s AS (SELECT world, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy, sum((y - p) * (y - p)) AS see FROM pr GROUP BY world),
 num AS (SELECT *, row_number() OVER (ORDER BY world % 64, world) - 1 AS idx FROM s), k AS (SELECT count(*) AS k FROM s),
 dr AS (SELECT id // k AS rep, id % k AS slot, k FROM k, range(0, 2000 * (SELECT count(*) FROM s)) r(id)),
 pk AS (SELECT rep, ({E.mixed_draw_sql('rep', 'slot', 7)}) % k AS idx FROM dr),
 rp AS (SELECT rep, sum(n) AS n, sum(sy) AS sy, sum(syy) AS syy, sum(see) AS see FROM pk JOIN num USING (idx) GROUP BY rep),
 r2 AS (SELECT 1 - see / (syy - sy * sy / n) AS r2 FROM rp WHERE syy - sy * sy / n > 0)
SELECT count(*) AS n_replicates, {R('avg(r2)', alias='mean_r2')}, {R('quantile_cont(r2, 0.025)', alias='r2_low')}, {R('quantile_cont(r2, 0.975)', alias='r2_high')} FROM r2""")
def cluster_bootstrap(spark, folder):
    return rounded(E.cluster_bootstrap(A.price_pairs(spark, folder), "world"), ["n_replicates"], ["mean_r2", "r2_low", "r2_high"])


_CLS = """cl AS (SELECT l_linestatus || l_returnflag AS y, ['FA','FN','FR','OA','ON','OR'][(list_position(['FA','FN','FR','OA','ON','OR'], l_linestatus || l_returnflag) - 1 + l_linenumber % 3) % 6 + 1] AS p FROM lineitem)"""
_REP = _CLS + """, lb AS (SELECT DISTINCT y AS label FROM cl UNION SELECT DISTINCT p FROM cl),
 ct AS (SELECT label, (SELECT count(*) FROM cl WHERE y = label) AS support, (SELECT count(*) FROM cl WHERE p = label) AS predicted, (SELECT count(*) FROM cl WHERE p = label AND y = label) AS tp FROM lb),
 rp AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM ct),
 rf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rp)"""


@query("confusion_matrix", f"WITH {_CLS} SELECT y, p, count(*) AS n FROM cl GROUP BY 1, 2")
def confusion_matrix(spark, folder):
    return E.confusion(A.class_pairs(spark, folder))


@query("confusion_metrics", f"WITH {_REP} SELECT label, support, predicted, tp, {Rs(['precision', 'recall', 'f1'])} FROM rf")
def confusion_metrics(spark, folder):
    return rounded(E.class_report(A.class_pairs(spark, folder)), ["label", "support", "predicted", "tp"], ["precision", "recall", "f1"])


@query("class_summary", f"""WITH {_REP} SELECT {R('avg(f1)', alias='macro_f1')}, {R('avg(recall) FILTER (WHERE support > 0)', alias='balanced_accuracy')}, {R('sum(tp) / sum(support)', alias='accuracy')},
 {R("coalesce(max(recall) FILTER (WHERE label = 'OR'), 0)", alias='critical_recall')} FROM rf""")
def class_summary(spark, folder):
    return rounded(E.class_summary(E.class_report(A.class_pairs(spark, folder)), "OR"), [], ["macro_f1", "balanced_accuracy", "accuracy", "critical_recall"])


_PROB = "pb AS (SELECT quality AS y, n_chars / (n_chars + 500e0) AS p FROM labels JOIN documents USING (doc_id))"
_REL = _PROB + ", rl AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed, sum((p - y) * (p - y)) AS sum_sq FROM pb GROUP BY 1)"


@query("reliability_table", f"WITH {_REL} SELECT bin, n, {Rs(['mean_p', 'observed', 'sum_sq'])} FROM rl")
def reliability_table(spark, folder):
    return rounded(E.reliability(A.quality_pairs(spark, folder)), ["bin", "n"], ["mean_p", "observed", "sum_sq"])


@query("brier_ece", f"WITH {_REL} SELECT CAST(sum(n) AS BIGINT) AS n, {R('sum(sum_sq) / sum(n)', alias='brier')}, {R('sum(n * abs(mean_p - observed)) / sum(n)', alias='ece')} FROM rl")
def brier_ece(spark, folder):
    return rounded(E.calibration_summary(E.reliability(A.quality_pairs(spark, folder))), ["n"], ["brier", "ece"])


@query("majority_class", f"WITH {_CLS} SELECT y, count(*) AS n FROM cl GROUP BY y ORDER BY n DESC, y LIMIT 1")
def majority_class(spark, folder):
    return E.majority_class(A.class_pairs(spark, folder), "y")


@query("world_folds", """WITH w AS (SELECT world, CAST((row_number() OVER (ORDER BY world % 64, world) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT l_suppkey AS world FROM lineitem))
SELECT fold, count(DISTINCT world) AS n_worlds, count(*) AS n_rows FROM lineitem JOIN w ON world = l_suppkey GROUP BY fold""")
def world_folds(spark, folder):
    from pitgauge.sources.readers import table
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("world"))
    return E.world_folds(rows, "world").groupBy("fold").agg(F.count_distinct("world").alias("n_worlds"), F.count(F.lit(1)).alias("n_rows"))


_VAR = f"""WITH {PANEL}, y AS (SELECT zone_id % 3 AS target, 'carry' AS variant, score AS p, lead(score) OVER w AS y FROM panel WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx)
 UNION ALL SELECT zone_id % 3, 'damped', 0.9e0 * score, lead(score) OVER w FROM panel WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx)
 UNION ALL SELECT zone_id % 3, 'shifted', score + 1e0, lead(score) OVER w FROM panel WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx)),
 m AS (SELECT target, variant, 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM y WHERE y IS NOT NULL GROUP BY 1, 2)"""


@query("best_variant", _VAR + f" SELECT target, variant, {R('r2')} FROM m QUALIFY row_number() OVER (PARTITION BY target ORDER BY m.r2 DESC, variant) = 1")
def best_variant(spark, folder):
    """Best of three simple forecasts per target by R2."""
    from pitgauge.operators import windows as W
    p = A.events_panel(spark, folder).select((F.col("zone_id") % 3).alias("target"), "score", W.future_value("score", 1, W.series_window()).alias("y"))
    v = p.where("y is not null").select("target", "y", F.inline(F.array(
        F.struct(F.lit("carry").alias("variant"), F.col("score").alias("p")), F.struct(F.lit("damped").alias("variant"), (0.9 * F.col("score")).alias("p")),
        F.struct(F.lit("shifted").alias("variant"), (F.col("score") + 1.0).alias("p")))))
    return rounded(E.best_variant(E.regression_metrics(v, ["target", "variant"]), "target", "r2", "variant"), ["target", "variant"], ["r2"])


@query("target_distribution", f"""WITH {PANEL} SELECT CASE WHEN seed < 3 THEN 'train' ELSE 'test' END AS split, count(*) AS n, {R('avg(score)', alias='mean_score')}, {R('stddev_pop(score)', alias='std_score')},
 {R('min(score)', alias='min_score')}, {R('quantile_cont(score, 0.5)', alias='p50')}, {R('quantile_cont(score, 0.9)', alias='p90')}, {R('max(score)', alias='max_score')}, count(*) FILTER (WHERE score >= 75) AS n_events FROM panel GROUP BY 1""")
def target_distribution(spark, folder):
    """Target report per split; the pools have no bound, so quantiles come from the distributed form."""
    from pitgauge.operators.quantiles import exact_quantiles, quantile_columns
    p = A.events_panel(spark, folder).select(F.when(F.col("seed") < 3, "train").otherwise("test").alias("split"), "score")
    q = quantile_columns(exact_quantiles(p, "score", [0.5, 0.9], ["split"]), ["split"], {0.5: "p50", 0.9: "p90"})
    s = p.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
                               F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count_if(F.col("score") >= 75).alias("n_events"))
    return rounded(s.join(q, "split"), ["split", "n", "n_events"], ["mean_score", "std_score", "min_score", "p50", "p90", "max_score"])
