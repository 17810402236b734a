"""Model queries; fits run on the panel with whole worlds held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgauge.functions import scoring as S
from pitgauge.operators import attribution as AT
from pitgauge.operators import evaluation as E
from pitgauge.operators import modeling as M
from pitgauge.operators import windows as W
from pitgauge.operators.boards import apply_overrides
from pitgauge.operators.stats import sampled_row
from pitgauge.operators.task_forest import TaskClassForest, TaskForest
from pitgauge.plans.registry import R, query, rounded
from pitgauge.plans.score_plans import override_requests
from pitgauge.plans.sql import PANEL
from pitgauge.session import cut_lineage, shared_dir
from pitgauge.sources import adapters as A
from pitgauge.sources import readers as RD

NUMERIC = ["rainfall_mm", "groundwater_proxy", "crack_density", "ppv", "growth"]
TREND = ["rainfall_3d_mm", "gw_delta_3d", "crack_growth_3d", "ppv_max_3d"]
LABEL = "target"
SMALL = {"numTrees": 20, "maxDepth": 6}
FOLDS = 3


def every_row(spark, folder, trend=False):
    """Features today of every (seed, zone_id, day_idx), and the score tomorrow, which the last day of a series does not have."""
    p = A.events_panel(spark, folder)
    p = W.temporal_features(p) if trend else p
    p = p.withColumn(LABEL, W.future_value("score", 1, W.series_window()))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("upper", "middle", "seam", "floor")]), (F.col("zone_id") % 4 + 1).cast("int"))
    cols = [*NUMERIC, *(TREND if trend else [])]
    return p.select("seed", "zone_id", "day_idx", kind.alias("kind"), LABEL, "score", *cols)


def dataset(spark, folder, trend=False):
    """Features today, score tomorrow; worlds 0-2 train, 3 validation, 4 test."""
    return every_row(spark, folder, trend).where(F.col(LABEL).isNotNull()).persist()


def folded_rows(spark, folder):
    """Every row with its training world's ``fold``; it is null in the worlds that no fit sees."""
    rows = cut_lineage(every_row(spark, folder))  # a fit has hundreds of jobs, and each would carry the panel's plan
    seen = F.coalesce(F.col("seed") <= 2, F.lit(False))
    return cut_lineage(E.world_folds(rows.where(seen), "seed", FOLDS).unionByName(rows.where(~seen), allowMissingColumns=True))


def whole_forest():
    """The contract's forest, 500 trees of depth 12; queries that need the same fit read the parts that the first one has published."""
    return TaskForest(LABEL, NUMERIC, ["kind"])


def unseen_forests(rows, forest):
    """A forest for each fold that did not see its worlds, and one on all training worlds for the others."""
    train = rows.where(F.col("fold").isNotNull() & F.col(LABEL).isNotNull()).persist()
    models, whole = M.side_by_side(rows.sparkSession, [lambda: M.fold_models(forest, train, "fold", FOLDS), lambda: forest.fit(train)])
    return train, models, whole


def _parts(d):
    return d.where("seed <= 2"), d.where("seed = 3"), d.where("seed = 4")


@query("mean_baseline", f"""WITH {PANEL}, d AS (SELECT seed, lead(score) OVER (PARTITION BY seed, zone_id ORDER BY day_idx) AS y FROM panel), t AS (SELECT avg(y) AS m FROM d WHERE seed <= 2)
SELECT count(*) AS n, {R('avg(abs(y - m))', alias='mae')}, {R('sqrt(avg((y - m) * (y - m)))', alias='rmse')}, {R('1 - sum((y - m) * (y - m)) / (sum(y * y) - sum(y) * sum(y) / count(*))', alias='r2')} FROM d, t WHERE seed = 4 AND y IS NOT NULL""")
def mean_baseline(spark, folder):
    train, _, test = _parts(dataset(spark, folder))
    return rounded(E.regression_metrics(M.mean_baseline(train, test, LABEL), [], LABEL, "prediction"), ["n"], ["mae", "rmse", "r2"])


@query("linear_fit", f"""WITH {PANEL}, d AS (SELECT seed, groundwater_proxy AS x, lead(score) OVER (PARTITION BY seed, zone_id ORDER BY day_idx) AS y FROM panel),
 t AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM d WHERE seed <= 2 AND y IS NOT NULL)
SELECT count(*) AS n, {R('avg(abs(y - a * x - b))', 3, 'mae')}, {R('1 - sum((y - a * x - b) * (y - a * x - b)) / (sum(y * y) - sum(y) * sum(y) / count(*))', 3, 'r2')} FROM d, t WHERE seed = 4 AND y IS NOT NULL""")
def linear_fit(spark, folder):
    """Least squares on one feature, against the closed form."""
    train, _, test = _parts(dataset(spark, folder))
    model = M.pipeline("ridge", LABEL, ["groundwater_proxy"], regParam=0.0, solver="normal").fit(train)
    return rounded(M.evaluate(model, test, LABEL), ["n"], ["mae", "r2"], 3)


@query("model_leaderboard")
def model_leaderboard(spark, folder):
    """Mean, ridge, forest and boosted models on the held-out world."""
    shared_dir(spark)  # for the checkpoints of boosting
    train, _, test = _parts(dataset(spark, folder))
    out = E.regression_metrics(M.mean_baseline(train, test, LABEL), [], LABEL, "prediction").withColumn("model", F.lit("mean"))
    for kind, params in {"ridge": {}, "forest": SMALL, "boosted": {}}.items():
        rows = M.few_partitions(train) if kind == "boosted" else train
        fitted = M.pipeline(kind, LABEL, NUMERIC, ["kind"], **params).fit(rows)
        out = out.unionByName(M.evaluate(fitted, test, LABEL).withColumn("model", F.lit(kind)))
    return rounded(out, ["model", "n"], ["mae", "rmse", "r2"])


def _forest_and_calibrator(d):
    """Forest on the training worlds, calibrated on predictions for worlds it did not see."""
    train, _, _ = _parts(d)
    folded = E.world_folds(train, "seed", 3)
    oof = M.out_of_fold(M.pipeline("forest", LABEL, NUMERIC, ["kind"], **SMALL), folded, "fold", 3)
    return M.pipeline("forest", LABEL, NUMERIC, ["kind"], **SMALL).fit(train), M.fit_calibrator(oof, LABEL)


@query("forest_scores")
def forest_scores(spark, folder):
    """Batch scores of every zone and day: integer score, calibrated confidence, band.

    No row's score is of a forest that saw its world. The confidence map is the contract's, one for all: fitted on the training worlds' unseen predictions.
    """
    rows = folded_rows(spark, folder)
    train, models, model = unseen_forests(rows, whole_forest())
    cal = M.fit_calibrator(M.predict_unseen(models, train, "fold"), LABEL)
    return M.score_predictions(M.predict_unseen(models, rows, "fold", model), cal).select("seed", "zone_id", "day_idx", F.round("raw", 4).alias("raw"), "score_int", "confidence", "band")


@query("isotonic_calibration")
def isotonic_calibration(spark, folder):
    """Brier score and calibration error with and without the isotonic map, on the validation world."""
    d = dataset(spark, folder)
    model, cal = _forest_and_calibrator(d)
    v = M.batch_score(model, d.where("seed = 3"), cal).withColumn("y", S.event_flag(LABEL))
    pairs = v.select("y", F.inline(F.array(
        F.struct(F.lit("isotonic").alias("method"), F.col("confidence").alias("p")),
        F.struct(F.lit("score_over_100").alias("method"), (F.col("score_int") / 100.0).alias("p")))))
    parts = [E.calibration_summary(E.reliability(pairs.where(F.col("method") == m))).withColumn("method", F.lit(m)) for m in ("isotonic", "score_over_100")]
    return rounded(parts[0].unionByName(parts[1]), ["method", "n"], ["brier", "ece"])


@query("random_search")
def random_search(spark, folder):
    """Random search over forest parameters with whole-world folds."""
    train, _, _ = _parts(dataset(spark, folder))
    folded = E.world_folds(train, "seed", 3).persist()
    found = M.random_search(M.pipeline("forest", LABEL, NUMERIC, **SMALL), {"maxDepth": [3, 5, 7], "minInstancesPerNode": [1, 5]}, 3, folded, LABEL, "fold", 3)
    return spark.createDataFrame(M.search_table(found), "params string, rmse double")


@query("permutation_importance")
def permutation_importance(spark, folder):
    train, _, test = _parts(dataset(spark, folder))
    model = M.pipeline("ridge", LABEL, NUMERIC).fit(train)
    return rounded(M.permutation_importance(model, test, ["seed", "zone_id", "day_idx"], NUMERIC, LABEL), ["feature"], ["importance", "spread"])


@query("monotone_sweep")
def monotone_sweep(spark, folder):
    d = dataset(spark, folder)
    train, _, test = _parts(d)
    model = M.pipeline("forest", LABEL, NUMERIC, **SMALL).fit(train)
    base = sampled_row(test, ["zone_id"], F.xxhash64("zone_id", "day_idx"), *NUMERIC)
    return rounded(M.monotonicity_sweep(model, base, train, NUMERIC), ["feature", "n_points"], ["rise"])


@query("linear_contributions")
def linear_contributions(spark, folder):
    """Four largest additive terms of each prediction of the held-out world."""
    train, _, test = _parts(dataset(spark, folder))
    c = M.linear_contributions(M.pipeline("ridge", LABEL, NUMERIC).fit(train), test, NUMERIC)
    return c.select("zone_id", "day_idx", F.posexplode("contributions").alias("rank", "c")).select("zone_id", "day_idx", "rank", "c.feature", F.round("c.term", 4).alias("term"))


@query("global_importance")
def global_importance(spark, folder):
    train, _, test = _parts(dataset(spark, folder))
    c = M.linear_contributions(M.pipeline("ridge", LABEL, NUMERIC).fit(train), test, NUMERIC, len(NUMERIC))
    return rounded(M.global_importance(c), ["feature", "n"], ["mean_abs_term"])


@query("replacement_contributions")
def replacement_contributions(spark, folder):
    """Forest attribution by replacing one feature with its baseline."""
    train, _, test = _parts(dataset(spark, folder))
    model = M.pipeline("forest", LABEL, NUMERIC, **SMALL).fit(train)
    return rounded(M.replacement_contributions(model, test, ["zone_id", "day_idx"], NUMERIC, {f: 0.0 for f in NUMERIC}), ["zone_id", "day_idx", "feature"], ["term"])


@query("tree_contributions")
def tree_contributions(spark, folder):
    """Four largest terms of each prediction of every zone and day, by a forest that did not see its world: base and all terms sum to the prediction."""
    rows = folded_rows(spark, folder)
    _, models, model = unseen_forests(rows, M.pipeline("forest", LABEL, NUMERIC, **SMALL))
    parts = [(m, rows.where(F.col("fold") == i)) for i, m in enumerate(models)] + [(model, rows.where(F.col("fold").isNull()))]
    out = None
    for m, part in parts:
        t = AT.tree_contributions(m, part.select("seed", "zone_id", "day_idx", *NUMERIC), NUMERIC)
        out = t if out is None else out.unionByName(t)
    gap = F.abs(F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["term"]) - F.col("prediction")) < 1e-6
    top = out.select("seed", "zone_id", "day_idx", F.round("base", 4).alias("base"), F.round("prediction", 4).alias("prediction"), gap.alias("adds_up"), F.posexplode(F.slice("contributions", 1, 4)).alias("rank", "c"))
    return top.select("seed", "zone_id", "day_idx", "rank", "c.feature", F.round("c.term", 4).alias("term"), "base", "prediction", "adds_up")


@query("feature_ablation")
def feature_ablation(spark, folder):
    """Static, dynamic and trend feature groups, and the signed effect of the trend columns."""
    train, _, test = _parts(dataset(spark, folder, trend=True))
    groups = {"static": ["crack_density"], "dynamic": ["rainfall_mm", "groundwater_proxy", "ppv"], "all": NUMERIC, "all_plus_trend": [*NUMERIC, *TREND]}
    res = M.ablation(train, test, LABEL, groups, "ridge")
    return rounded(res, ["variant", "n"], ["mae", "rmse", "r2"])


@query("added_context")
def added_context(spark, folder):
    train, _, test = _parts(dataset(spark, folder, trend=True))
    res = M.ablation(train, test, LABEL, {"base": NUMERIC, "added": [*NUMERIC, "rainfall_3d_mm", "gw_delta_3d"]}, "ridge")
    return rounded(M.context_delta(res, "base", "added"), ["keep"], ["r2_base", "r2_added", "delta_r2"])


@query("coverage_curve")
def coverage_curve(spark, folder):
    d = dataset(spark, folder)
    return rounded(M.coverage_curve(d, d.where("seed = 4"), "seed", [1, 2, 3, 4], LABEL, NUMERIC, "ridge"), ["variant", "n"], ["mae", "rmse", "r2"])


@query("per_zone_models")
def per_zone_models(spark, folder):
    train, _, test = _parts(dataset(spark, folder))
    return rounded(M.per_zone_models(train, test, "kind", ["upper", "middle", "seam", "floor"], LABEL, NUMERIC, "ridge"), ["kind", "n"], ["mae", "rmse", "r2"])


@query("class_forest")
def class_forest(spark, folder):
    """Class-weighted forest on score bands of the next day."""
    d = dataset(spark, folder).withColumn("label", S.score_band(LABEL))
    whole = M.forest_classifier("label", NUMERIC, ["kind"]).getStages()[-1]
    forest = TaskClassForest("label", NUMERIC, ["kind"], trees=whole.getNumTrees(), depth=whole.getMaxDepth(), seed=whole.getSeed(), minInstancesPerNode=whole.getMinInstancesPerNode())
    model = forest.fit(M.with_class_weights(d.where("seed <= 2"), "label"))
    report = E.class_report(M.predicted_labels(model, d.where("seed = 4"), "label"))
    return rounded(report, ["label", "support", "predicted", "tp"], ["precision", "recall", "f1"])


@query("model_counterfactual")
def model_counterfactual(spark, folder):
    """Overridden zones of every world, as of their last day, re-scored beside their baseline by a forest that did not see their world."""
    rows = folded_rows(spark, folder)
    _, models, model = unseen_forests(rows, M.pipeline("forest", LABEL, NUMERIC, **SMALL))
    z = RD.latest_states(rows)
    merged, _ = apply_overrides(z, override_requests(z), "zone_id", ["ppv", "groundwater_proxy", "crack_density"])
    score = lambda r: M.score_predictions(M.predict_unseen(models, r, "fold", model))
    base = score(z).select("zone_id", F.col("score_int").alias("baseline"))
    sim = score(merged).select("zone_id", F.col("score_int").alias("simulated"), "band")
    return base.join(sim, "zone_id").select("zone_id", "baseline", "simulated", (F.col("simulated") - F.col("baseline")).alias("delta"), "band")
