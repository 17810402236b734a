"""The model queries do the whole job on the smallest tables."""

import inspect
import os

import pytest
from pyspark.sql import functions as F

from pitgauge.operators import modeling as M
from pitgauge.plans import load_all
from pitgauge.sources import adapters as A

FOLDER = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")
REG = load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not present")


def test_every_zone_and_day_gets_a_batch_score(spark):
    keys = ["seed", "zone_id", "day_idx"]
    want = A.events_panel(spark, FOLDER).select(*keys)
    got = REG.QUERIES["forest_scores"](spark, FOLDER).persist()
    assert got.where("raw is null or score_int is null or confidence is null or band is null").count() == 0
    assert {r.seed for r in got.select("seed").distinct().collect()} == {0, 1, 2, 3, 4}
    assert got.count() == want.count() and want.exceptAll(got.select(*keys)).count() == 0


def test_counterfactuals_reach_every_zone_with_a_good_request(spark):
    zones = {r.zone_id for r in A.events_panel(spark, FOLDER).select("zone_id").distinct().collect()}
    got = [r.zone_id for r in REG.QUERIES["model_counterfactual"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(z for z in zones if z % 3 != 2)


def test_rows_are_predicted_by_a_model_that_did_not_see_their_fold(spark):
    rows = spark.createDataFrame([(f, float(i), 10.0 * f) for f in range(3) for i in range(20)] + [(None, float(i), 0.0) for i in range(5)], "fold int, x double, y double")
    train = rows.where("fold is not null")
    flat = M.pipeline("ridge", "y", ["x"])
    got = M.predict_unseen(M.fold_models(flat, train, "fold", 3), rows, "fold", flat.fit(train))
    assert {r.fold: (r.p, r.n) for r in got.groupBy("fold").agg(F.round(F.avg("prediction"), 3).alias("p"), F.count("*").alias("n")).collect()} == {
        0: (15.0, 20), 1: (10.0, 20), 2: (5.0, 20), None: (10.0, 5)}


class Made(Exception):
    """Ends a query once what it fits is known."""


def test_boosting_and_class_forest_have_the_contract_sizes(spark, monkeypatch):
    regressor, classifier, made = M.regressor, M.forest_classifier, {}

    def boosted(kind, label, **params):
        made[kind] = regressor(kind, label, **params)
        if kind == "boosted":
            raise Made
        return made[kind]

    def forest(*args, **params):
        made["classes"] = classifier(*args, **params).getStages()[-1]
        raise Made

    monkeypatch.setattr(M, "regressor", boosted)
    monkeypatch.setattr(M, "forest_classifier", forest)
    for name in ("model_leaderboard", "class_forest"):
        with pytest.raises(Made):
            REG.QUERIES[name](spark, FOLDER)
    b, c = made["boosted"], made["classes"]
    assert (b.getMaxIter(), b.getMaxDepth(), b.getStepSize()) == (300, 6, 0.05)
    assert (c.getNumTrees(), c.getMaxDepth(), c.getMinInstancesPerNode()) == (300, 30, 2)


def test_permutation_importance_has_ten_repeats(spark, monkeypatch):
    signature = inspect.signature(M.permutation_importance)

    def repeats(*args, **params):
        call = signature.bind(*args, **params)
        call.apply_defaults()
        raise Made(call.arguments["repeats"])

    monkeypatch.setattr(M, "permutation_importance", repeats)
    with pytest.raises(Made, match="^10$"):
        REG.QUERIES["permutation_importance"](spark, FOLDER)
