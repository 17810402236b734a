"""Model jobs on pyspark.ml: preprocessing, fits, search, calibration, explanation, studies.

Splits keep whole worlds together; every choice is made on validation data before any refit.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor, IsotonicRegression, IsotonicRegressionModel, LinearRegression, RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgauge.functions import scoring as S
from pitgauge.operators.evaluation import metrics_from_sums, error_sums, regression_metrics
from pitgauge.operators.joins import dense_index, measured
from pitgauge.operators.quantiles import exact_quantiles
from pitgauge.session import cut_lineage

#: Rows in a partition of a fit. Each partition sends its statistics of all open nodes, so few partitions cost less than many.
TASK_ROWS = 500_000


def few_partitions(rows: DataFrame, least: int = 20_000) -> DataFrame:
    """Rows written once and dealt evenly to one partition for each ``TASK_ROWS``, on smaller tables to one for each ``least`` up to the number of cores.

    Boosting runs several short jobs for each round, so its time on small tables is the number of their tasks.
    """
    once = cut_lineage(rows)
    n, cores = once.count(), rows.sparkSession.sparkContext.defaultParallelism
    return once.repartition(max(1, math.ceil(n / TASK_ROWS), min(cores, math.ceil(n / least))))


def preprocessing(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Scale numbers and one-hot encode categories; unseen categories get their own slot."""
    stages, parts = [VectorAssembler(inputCols=list(numeric), outputCol="_num", handleInvalid="keep"),
                     StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True)], ["_scaled"]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"_{c}_i", handleInvalid="keep"),
                   OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v", handleInvalid="keep")]
        parts.append(f"_{c}_v")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def regressor(kind: str, label: str, **params):
    """forest (500 trees, depth 12), ridge or boosted (300 rounds of depth 6 at a rate of 0.05), with overridable parameters.

    Boosting cuts its lineage every ten rounds if a checkpoint folder is set (``session.shared_dir``).
    """
    if kind == "forest":
        return RandomForestRegressor(labelCol=label, **{"numTrees": 500, "maxDepth": 12, "seed": 42, **params})
    if kind == "ridge":
        return LinearRegression(labelCol=label, **{"regParam": 0.001, "elasticNetParam": 0.0, **params})
    if kind == "boosted":
        return GBTRegressor(labelCol=label, **{"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "seed": 42, **params})
    raise ValueError(f"unknown regressor {kind!r}")


def pipeline(kind: str, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), **params) -> Pipeline:
    return Pipeline(stages=[*preprocessing(numeric, categorical), regressor(kind, label, **params)])


def mean_baseline(train: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """The training mean as the prediction for every row."""
    return rows.withColumn("prediction", train.agg(F.avg(label)).scalar())


def evaluate(model: PipelineModel, rows: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return regression_metrics(model.transform(rows), by, y=label, p="prediction")


def random_search(pipe: Pipeline, grid: dict, n: int, rows: DataFrame, label: str, fold: str, k: int,
                  seed: int = 0, parallelism: int = 4) -> CrossValidatorModel:
    """n random points of a grid of the final stage's parameters, scored by RMSE over world folds."""
    est = pipe.getStages()[-1]
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    chosen = random.Random(seed).sample(points, min(n, len(points)))
    maps = [{getattr(est, name): value for name, value in p.items()} for p in chosen]
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, foldCol=fold, numFolds=k, parallelism=parallelism,
                        evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"))
    return cv.fit(rows)


def search_table(result: CrossValidatorModel) -> list[tuple[str, float]]:
    """(parameters, mean RMSE) of every candidate; as many rows as candidates."""
    maps = result.getEstimatorParamMaps()
    return [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)), float(s))
            for m, s in zip(maps, result.avgMetrics)]


def side_by_side(spark: SparkSession, calls: Sequence[Callable], parallelism: int = 2) -> list:
    """The results of the calls in their order, a few of them at a time: what one does on the driver goes on while tasks of another run."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda call: call(), [inheritable_thread_target(spark)(c) for c in calls]))


def fold_models(pipe: Pipeline, rows: DataFrame, fold: str, k: int) -> list[PipelineModel]:
    """For each fold a model that saw the others only."""
    rows = rows.persist()
    return [pipe.fit(rows.where(F.col(fold) != i)) for i in range(k)]


def predict_unseen(models: Sequence[PipelineModel], rows: DataFrame, fold: str, held_out: PipelineModel | None = None) -> DataFrame:
    """Predictions for each fold by its own model, and for rows without a fold by ``held_out``; without that, those rows are left out."""
    calls = [lambda i=i, m=m: m.transform(rows.where(F.col(fold) == i)) for i, m in enumerate(models)]
    if held_out is not None:
        calls.append(lambda: held_out.transform(rows.where(F.col(fold).isNull())))
    parts = side_by_side(rows.sparkSession, calls)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def out_of_fold(pipe: Pipeline, rows: DataFrame, fold: str, k: int) -> DataFrame:
    """Predictions for each fold by a model that saw the others only."""
    rows = rows.persist()
    return predict_unseen(fold_models(pipe, rows, fold, k), rows, fold)


def fit_calibrator(predicted: DataFrame, label: str, threshold: float = 75.0, resolution: float = 0.01) -> IsotonicRegressionModel:
    """Isotonic map from score to P(label >= threshold).

    Scores are grouped at ``resolution`` points with their counts as weights, so the pooling
    step works on at most 100/resolution rows whatever the number of predictions.
    """
    grid = F.round(F.col("prediction") / resolution) * resolution
    y = S.event_flag(label, threshold).cast("double")
    table = predicted.groupBy(grid.alias("x")).agg(F.avg(y).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    return IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", predictionCol="p").fit(table)


def batch_score(model: PipelineModel, rows: DataFrame, calibrator: IsotonicRegressionModel | None = None) -> DataFrame:
    """Raw prediction, integer score, confidence and band."""
    return score_predictions(model.transform(rows), calibrator)


def score_predictions(predicted: DataFrame, calibrator: IsotonicRegressionModel | None = None) -> DataFrame:
    """Rows with a ``prediction``, whichever model made it, as in ``batch_score``."""
    scored = predicted.withColumn("raw", F.col("prediction"))
    if calibrator is not None:
        scored = calibrator.transform(scored.withColumn("x", F.col("raw"))).drop("x")
    score = S.round_score("raw")
    conf = S.confidence(score, F.col("p") if calibrator is not None else None)
    return scored.withColumns({"score_int": score, "confidence": conf}).withColumn("band", S.score_band("score_int"))


def permutation_importance(model: PipelineModel, rows: DataFrame, key: Sequence[str], features: Sequence[str], label: str,
                           repeats: int = 10, seed: int = 0, buckets: int = 64) -> DataFrame:
    """Loss of R2 when one column is shuffled, per feature, mean and deviation over repeats.

    Rows get gap-free numbers in hash order; repeat r takes each value from row (a*i + b) mod n
    with a coprime to n, which is a permutation found by an equi-join and needs no global sort.
    """
    h = F.xxhash64(*key, F.lit(seed))
    rows = rows.select(*key, *features, label)
    numbered = measured(dense_index(rows, F.pmod(h, F.lit(buckets)), [h, *key]))
    n = numbered.count()
    rng = random.Random(seed)
    steps = []
    while len(steps) < repeats:
        a = rng.randrange(1, max(n, 2))
        if math.gcd(a, n) == 1 or n == 1:
            steps.append((a, rng.randrange(max(n, 1))))
    shifts = F.array(*[F.struct(F.lit(i).alias("r"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(steps)])
    left = numbered.select("*", F.explode(shifts).alias("t"))
    left = left.select("*", F.col("t.r").alias("repeat"), F.pmod(F.col("idx") * F.col("t.a") + F.col("t.b"), F.lit(n)).alias("_partner")).drop("idx", "t")
    other = numbered.select(F.col("idx").alias("_partner"), *[F.col(f).alias(f"_o_{f}") for f in features])
    pairs = left.join(other, "_partner")
    variants = pairs.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    shuffled = variants.select("feature", "repeat", label, *[
        F.when(F.col("feature") == f, F.col(f"_o_{f}")).otherwise(F.col(f)).alias(f) for f in features])
    per = metrics_from_sums(error_sums(model.transform(shuffled), ["feature", "repeat"], label, "prediction"), ["feature", "repeat"])
    base = metrics_from_sums(error_sums(model.transform(numbered), [], label, "prediction"), []).select("r2").scalar()
    loss = per.withColumn("loss", base - F.col("r2"))
    return loss.groupBy("feature").agg(F.avg("loss").alias("importance"), F.stddev_pop("loss").alias("spread"))


def monotonicity_sweep(model: PipelineModel, base: DataFrame, population: DataFrame, features: Sequence[str],
                       points: int = 12) -> DataFrame:
    """Mean prediction along each feature's p2..p98 grid, and the rise from the first to the last three points."""
    long = population.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])))
    q = exact_quantiles(long, "v", [0.02, 0.98], ["feature"])
    bounds = measured(q.groupBy("feature").agg(F.max(F.when(F.col("prob") == 0.02, F.col("quantile"))).alias("lo"),
                                               F.max(F.when(F.col("prob") == 0.98, F.col("quantile"))).alias("hi")))
    spec = bounds.agg(F.collect_list(F.struct("feature", "lo", "hi"))).scalar()
    grid = base.withColumn("_all", spec).withColumn("g", F.explode("_all")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    value = F.col("g.lo") + (F.col("g.hi") - F.col("g.lo")) * F.col("step") / float(points - 1)
    grid = grid.withColumns({"feature": F.col("g.feature"), **{
        f: F.when(F.col("g.feature") == f, value).otherwise(F.col(f)) for f in features}})
    mean = model.transform(grid).groupBy("feature", "step").agg(F.avg("prediction").alias("m"))
    last, first = F.col("step") >= points - 3, F.col("step") < 3
    return mean.groupBy("feature").agg((F.avg(F.when(last, F.col("m"))) - F.avg(F.when(first, F.col("m")))).alias("rise"),
                                       F.count(F.lit(1)).alias("n_points"))


def linear_contributions(model: PipelineModel, rows: DataFrame, numeric: Sequence[str], top: int = 4) -> DataFrame:
    """Exact additive terms coef * (x - mean) of a linear model as an array, largest first.

    These are the terms of the linear model, not a tree attribution.
    """
    coefs = F.array(*[F.lit(float(c)) for c in model.stages[-1].coefficients[: len(numeric)]])
    names = F.array(*[F.lit(n) for n in numeric])
    scaled = model.transform(rows).withColumn("_x", vector_to_array("_scaled")).withColumns({"_w": coefs, "_n": names})
    terms = F.transform("_n", lambda n, i: F.struct(n.alias("feature"), (F.get("_x", i) * F.get("_w", i)).alias("term")))
    ordered = F.array_sort(terms, lambda a, b: F.when(F.abs(a["term"]) > F.abs(b["term"]), -1).when(F.abs(a["term"]) < F.abs(b["term"]), 1).otherwise(0))
    return scaled.withColumn("contributions", F.slice(ordered, 1, top)).drop("_x", "_w", "_n")


def replacement_contributions(model: PipelineModel, rows: DataFrame, key: Sequence[str], features: Sequence[str],
                              baseline: dict[str, float]) -> DataFrame:
    """Change of any model's prediction when a feature is set to its baseline, one row per feature."""
    variants = rows.select(*key, *features).withColumn("feature", F.explode(F.array(*[F.lit(f) for f in ["", *features]])))
    replaced = variants.select(*key, "feature", *[
        F.when(F.col("feature") == f, F.lit(float(baseline[f]))).otherwise(F.col(f)).alias(f) for f in features])
    pred = model.transform(replaced).select(*key, "feature", "prediction")
    full = pred.where("feature = ''").select(*key, F.col("prediction").alias("full"))
    return pred.where("feature <> ''").join(full, list(key)).select(*key, "feature", (F.col("full") - F.col("prediction")).alias("term"))


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute term per feature of rows carrying a full ``contributions`` array."""
    t = contributions.select(F.inline("contributions"))
    return t.groupBy("feature").agg(F.avg(F.abs("term")).alias("mean_abs_term"), F.count(F.lit(1)).alias("n"))


def ablation(train: DataFrame, test: DataFrame, label: str, groups: dict[str, Sequence[str]], kind: str, **params) -> DataFrame:
    """Test metrics of the same model on different feature groups, as a long table."""
    out = None
    for name, cols in groups.items():
        m = evaluate(pipeline(kind, label, cols, **params).fit(train), test, label).withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("variant", "n", "mae", "rmse", "r2")


def coverage_curve(rows: DataFrame, test: DataFrame, world: str, sizes: Sequence[int], label: str, numeric: Sequence[str],
                   kind: str, **params) -> DataFrame:
    """Test metrics against the number of training worlds (the first N by key)."""
    return ablation_by_frame({str(n): rows.where(F.col(world) < n) for n in sizes}, test, label, numeric, kind, **params)


def ablation_by_frame(frames: dict[str, DataFrame], test: DataFrame, label: str, numeric: Sequence[str], kind: str, **params) -> DataFrame:
    out = None
    for name, train in frames.items():
        m = evaluate(pipeline(kind, label, numeric, **params).fit(train), test, label).withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("variant", "n", "mae", "rmse", "r2")


def context_delta(results: DataFrame, base: str, added: str) -> DataFrame:
    """Signed change of R2 from an added context; a fall is reported as a fall."""
    r = lambda v: F.max(F.when(F.col("variant") == v, F.col("r2")))
    out = results.agg(r(base).alias("r2_base"), r(added).alias("r2_added"))
    d = F.col("r2_added") - F.col("r2_base")
    return out.withColumns({"delta_r2": d, "keep": d > 0.005})


def per_zone_models(train: DataFrame, test: DataFrame, zone: str, zones: Sequence, label: str, numeric: Sequence[str], kind: str, **params) -> DataFrame:
    """A fit and an evaluation per zone, for a given short list of zones."""
    out = None
    for z in zones:
        m = pipeline(kind, label, numeric, **params).fit(train.where(F.col(zone) == z))
        e = evaluate(m, test.where(F.col(zone) == z), label).withColumn(zone, F.lit(z))
        out = e if out is None else out.unionByName(e)
    return out


def with_class_weights(train: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """n / (k * n_c) per class, from one aggregate over the classes of an enumeration."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc")).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    w = counts.withColumn(weight, total / (k * F.col("_nc"))).drop("_nc")
    return train.join(measured(w), label)


def forest_classifier(label: str, numeric: Sequence[str], categorical: Sequence[str] = (), weight: str = "weight", **params) -> Pipeline:
    """300 trees with at least two rows in a leaf, as deep as pyspark.ml grows them (30 levels)."""
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc")
    rf = RandomForestClassifier(labelCol="_label", weightCol=weight, **{"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 2, "seed": 42, **params})
    return Pipeline(stages=[index, *preprocessing(numeric, categorical), rf])


def predicted_labels(model: PipelineModel, rows: DataFrame, label: str) -> DataFrame:
    names = F.array(*[F.lit(v) for v in model.stages[0].labels])
    return model.transform(rows).select(F.col(label).alias("y"), F.get(names, F.col("prediction").cast("int")).alias("p"))
