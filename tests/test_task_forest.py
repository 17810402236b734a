"""Forests whose trees are grown in a task: the same job as the library's, from rows of a few bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitgauge.operators import split_forest as SF
from pitgauge.operators import task_forest as TF
from pitgauge.plans import model_plans as MP


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(400).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("kind"), F.col("id"))
    made = made.withColumn("y", F.col("a") * 2 + F.col("b") + F.when(F.col("kind") == "k1", 5.0).otherwise(0.0))
    return made.withColumn("label", F.when(F.col("y") > 25, "high").when(F.col("y") > 12, "mid").otherwise("low")).withColumn("weight", 1.0 + F.col("id") % 2).persist()


def _plain_value(x, tree):
    feature, at, left, value = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] + (x[feature[node]] > at[node])
    return value[node]


@pytest.mark.parametrize("classes", [0, 3])
def test_a_tree_keeps_its_limits_and_its_leaves_hold_their_rows(classes):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (600, 4)).astype(np.uint8)
    y = (x[:, 0] // 3).astype(float) if classes else x[:, 0] * 2.0 + x[:, 1]
    given = TF.Rows(x, y, np.ones(600), rng.integers(1, 3, 600))
    spec = TF.Spec(5, 4, 8, classes, 4)
    bag = given.bag(spec, np.random.default_rng(9))
    tree = TF.grow_tree(given, spec, np.random.default_rng(9))
    level, todo = {0: 0}, [0]
    while todo:
        i = todo.pop()
        for child in (tree[2][i], tree[2][i] + 1) if tree[0][i] >= 0 else ():
            level[child] = level[i] + 1
            todo.append(child)
    assert len(level) == len(tree[0]) and 2 < max(level.values()) <= 5
    got = TF.tree_values(bag[0], tree)
    assert all(np.array_equal(v, _plain_value(r, tree)) for v, r in zip(got, bag[0]))
    for value in np.unique(got, axis=0):
        here = np.all(got == value, axis=1)
        assert bag[1][here].sum() >= 4
        if classes:
            np.testing.assert_allclose(value, np.bincount(bag[3][here], bag[1][here], 3) / bag[1][here].sum())
        else:
            np.testing.assert_allclose(value[0], bag[3][here].sum() / bag[1][here].sum())


def test_scores_are_those_of_the_librarys_forest_and_parts_are_kept(spark, rows, tmp_path, monkeypatch):
    args, more = ("y", ["a", "b"], ["kind"]), {"trees": 40, "part_trees": 15, "depth": 8}
    asked = rows.unionByName(rows.where("id < 9"))
    model = TF.TaskForest(*args, folder=str(tmp_path / "t"), **more).fit(rows)
    got = {r.id: r.prediction for r in model.transform(asked).collect()}
    assert model.transform(asked).count() == 409 and model.tree_rows(spark).count() == 40 and len(model.places) == 3
    library = {r.id: r.prediction for r in SF.SplitForest(*args, folder=str(tmp_path / "s"), **more).fit(rows).transform(rows).collect()}
    y = {r.id: r.y for r in rows.collect()}
    mean = sum(y.values()) / len(y)
    loss = lambda p: sum((p[i] - v) ** 2 for i, v in y.items()) / sum((v - mean) ** 2 for v in y.values())
    assert len(got) == 400 and loss(got) < loss(library) + 0.03
    trees = [tuple(np.frombuffer(r[c], kind) for c, kind in (("feature", np.int16), ("bin", np.uint8), ("left", np.int32), ("value", float))) for r in model.tree_rows(spark).collect()]
    for r in TF.binned(model.prep.transform(rows), model.edges).where("id % 57 = 0").collect():
        assert got[r.id] == pytest.approx(sum(float(_plain_value(r.cell, t)) for t in trees) / 40)
    monkeypatch.setattr(TF, "grow_tree", None)
    monkeypatch.setattr(TF, "_grow", lambda *a: pytest.fail("fitted again"))
    again = TF.TaskForest(*args, folder=str(tmp_path / "t"), **more).fit(rows)
    assert {r.id: r.prediction for r in again.transform(rows).collect()} == pytest.approx(got)


def test_classes_are_the_most_votes_and_more_rows_go_to_the_library(spark, rows, tmp_path, monkeypatch):
    forest = TF.TaskClassForest("label", ["a", "b"], ["kind"], trees=9, part_trees=4, depth=30, folder=str(tmp_path))
    model = forest.fit(rows)
    out = model.transform(rows)
    assert model.stages[0].labels == ["high", "low", "mid"] and out.count() == 400
    assert out.where("prediction = _label").count() > 380
    monkeypatch.setattr(TF, "TASK_ROWS", 399)
    assert isinstance(forest.fit(rows), SF.SplitClassForestModel)


def test_borders_are_spread_over_the_values_beside_a_common_one(spark):
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=["v", "one"], outputCol="features").transform(spark.range(1000).select(F.when(F.col("id") < 700, 0.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("one")))
    edges, none = TF.borders(made, 32)
    assert none == [] and len(edges) == 31 and edges[0] == 0.0 and edges[1] < 720 and edges[-1] > 970
    cells = {tuple(r.cell) for r in TF.binned(made, [edges, none]).select("cell").distinct().collect()}
    assert len(cells) == 32 and max(cells) == (31, 0)


def test_the_queries_grow_their_forests_in_tasks():
    """500 trees of 12 levels in the library's way did not end within the limits at six times sf0.1."""
    forest = MP.whole_forest()
    assert isinstance(forest, TF.TaskForest) and sum(forest.sizes) == 500 and forest.depth == 12
    assert TF.Spec(12, 1, 32, 0, 10).some == 4 and TF.Spec(30, 2, 32, 6, 10).some == 4
