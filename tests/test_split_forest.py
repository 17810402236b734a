"""Forests in parts: the mean of all trees, fitted once, continued where a fit was broken off."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pitgauge.operators import modeling as M
from pitgauge.operators import split_forest as SF
from pitgauge.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(240).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("kind"), F.col("id"))
    return made.withColumn("y", F.col("a") * 2 + F.col("b") + F.when(F.col("kind") == "k1", 5.0).otherwise(0.0)).persist()


def forest(folder, **more):
    return SF.SplitForest("y", ["a", "b"], ["kind"], folder=folder, **{"trees": 7, "part_trees": 3, "depth": 4, "parallelism": 3, **more})


def test_prediction_is_the_mean_of_all_trees(spark, rows):
    model = forest(scratch_path(spark, "sf")).fit(rows)
    assert [m.getNumTrees for m in model.parts] == [3, 3, 1] and model.trees == 7
    got = model.transform(rows).select("features", "prediction", "y").collect()
    trees = [t for m in model.parts for t in m.trees]
    for r in got[::13]:
        assert abs(r.prediction - sum(t.predict(r.features) for t in trees) / 7) < 1e-9
    mean = sum(r.y for r in got) / len(got)
    assert sum((r.prediction - r.y) ** 2 for r in got) < 0.5 * sum((mean - r.y) ** 2 for r in got)
    assert not [c for c in model.transform(rows).columns if c.startswith("_part")]


def test_a_fit_goes_on_where_it_was_broken_off(spark, rows, monkeypatch):
    folder, real, fitted = scratch_path(spark, "sf"), SF.SplitForest.estimator, []

    def estimator(self, k, broken=True):
        if broken and k == 1:
            raise RuntimeError("executor lost")
        fitted.append(k)
        return real(self, k)

    monkeypatch.setattr(SF.SplitForest, "estimator", estimator)
    with pytest.raises(RuntimeError, match="lost"):
        forest(folder, parallelism=1).fit(rows)
    assert 0 in fitted and 1 not in fitted
    before = set(fitted)
    fitted.clear()
    monkeypatch.setattr(SF.SplitForest, "estimator", lambda self, k: estimator(self, k, False))
    first = forest(folder).fit(rows)
    assert set(fitted) == {0, 1, 2} - before
    fitted.clear()
    again = forest(folder).fit(rows)
    key = lambda m: [r.prediction for r in m.transform(rows).orderBy("id").collect()]
    assert not fitted and key(again) == pytest.approx(key(first))
    forest(folder).fit(rows.where("id > 9"))
    assert sorted(fitted) == [0, 1, 2]
    fitted.clear()
    forest(folder, depth=3).fit(rows)
    assert sorted(fitted) == [0, 1, 2]


def test_class_forest_in_parts_adds_the_votes_of_all_trees(spark, tmp_path):
    """Votes of the parts add up to those of all trees, a tie goes to the first class, and a part reads one partition however many the rows had."""
    rng = random.Random(2)
    rows = [(rng.random(), rng.random(), rng.choice("uv"), 1.0 + i % 2) for i in range(240)]
    df = spark.createDataFrame([(a, b, k, ("high" if a > 0.6 else "low" if b > 0.4 else "mid"), w) for a, b, k, w in rows], "a double, b double, kind string, label string, weight double").repartition(6)
    forest = SF.SplitClassForest("label", ["a", "b"], ["kind"], trees=7, depth=6, part_trees=3, folder=str(tmp_path))
    model = forest.fit(df)
    assert model.trees == 7 and [m.getNumTrees for m in model.parts] == [3, 3, 1]
    assert model.stages[0].labels == ["high", "low", "mid"]
    out = model.transform(df)
    assert out.columns[-1] == "prediction" and out.count() == 240
    ready = model.prep.transform(df)
    for m in model.parts:
        ready = m.copy({m.rawPredictionCol: f"r{m.uid}", m.probabilityCol: "", m.predictionCol: ""}).transform(ready)
    for r in ready.select(*[vector_to_array(f"r{m.uid}").alias(f"v{k}") for k, m in enumerate(model.parts)], "a", "b").join(out.select("a", "b", "prediction"), ["a", "b"]).collect():
        votes = [sum(v) for v in zip(r.v0, r.v1, r.v2)]
        assert r.prediction == votes.index(max(votes))
    right = out.where("prediction = _label").count()
    assert right > 200


def test_few_partitions_follow_the_rows(spark, monkeypatch):
    df = spark.range(1000).repartition(8)
    assert M.few_partitions(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "TASK_ROWS", 300)
    out = M.few_partitions(df)
    assert out.rdd.getNumPartitions() == 4 and out.count() == 1000
