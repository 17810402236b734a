"""Tree contributions against all subsets of features, and their sum against the model."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitgauge.operators import attribution as AT
from pitgauge.operators import modeling as M


def known_value(nodes, tree, x, known, i=0):
    """The tree's value if only the features ``known`` of a row are known: other splits are averaged by training rows."""
    r = nodes[tree, i]
    if r["leftChild"] < 0:
        return r["prediction"]
    left, right = nodes[tree, r["leftChild"]], nodes[tree, r["rightChild"]]
    if r["feature"] in known:
        return known_value(nodes, tree, x, known, (left if x[r["feature"]] <= r["cut"][0] else right)["id"])
    return sum(c["rawCount"] / r["rawCount"] * known_value(nodes, tree, x, known, c["id"]) for c in (left, right))


def plain_terms(rows, weights, x):
    nodes = {(r["tree"], r["id"]): r for r in rows}
    value = lambda known: sum(w * known_value(nodes, t, x, known) for t, w in enumerate(weights))
    n, out = len(x), []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        out.append(sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value({*s, i}) - value(set(s)))
                       for k in range(n) for s in combinations(others, k)))
    return out, value(set())


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).round(2)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, x[:, 2] * 4, -x[:, 3]) + rng.normal(size=400) / 10
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double, y double").persist()


@pytest.mark.parametrize("kind,params", [("forest", {"numTrees": 5, "maxDepth": 5}), ("boosted", {"maxIter": 4, "maxDepth": 3}), ("forest", {"numTrees": 1, "maxDepth": 0})])
def test_equals_all_subsets_and_sums_to_the_prediction(table, kind, params):
    names = list("abcde")
    model = M.pipeline(kind, "y", names, **params).fit(table)
    nodes = AT.saved_nodes(model.stages[-1]).collect()
    weights = np.array(model.stages[-1].treeWeights)
    weights = weights if kind == "boosted" else weights / weights.sum()
    scaled = {r["id"]: r["_x"] for r in model.transform(table).select("id", AT.vector_to_array("features").alias("_x")).collect()}
    got = AT.tree_contributions(model, table, names).select("id", "y", "prediction", "base", "contributions").collect()
    assert len(got) == 400
    for r in got:
        terms = {c["feature"]: c["term"] for c in r["contributions"]}
        assert r["base"] + sum(terms.values()) == pytest.approx(r["prediction"], abs=1e-6)
        assert [abs(c["term"]) for c in r["contributions"]] == sorted((abs(t) for t in terms.values()), reverse=True)
        if r["id"] % 40 == 0:
            want, base = plain_terms(nodes, weights, scaled[r["id"]])
            assert r["base"] == pytest.approx(base, abs=1e-9) and [terms[n] for n in names] == pytest.approx(want, abs=1e-9)
    top = AT.tree_contributions(model, table, names, top=2)
    assert top.agg(F.max(F.size("contributions"))).first()[0] == 2 and AT.tree_contributions(model, table.limit(0), names).count() == 0


def test_one_hot_slots(table):
    rows = table.withColumn("kind", F.when(F.col("a") > 0.7, "u").when(F.col("b") > 0, "v").otherwise("w"))
    model = M.pipeline("forest", "y", ["c", "d"], ["kind"], numTrees=4, maxDepth=4).fit(rows)
    n = len(model.transform(rows).select(AT.vector_to_array("features").alias("x")).first()["x"])
    got = AT.tree_contributions(model, rows, ["c", "d", *[f"kind_{i}" for i in range(n - 2)]]).collect()
    assert all(r["base"] + sum(c["term"] for c in r["contributions"]) == pytest.approx(r["prediction"], abs=1e-6) for r in got)
    assert any(c["feature"].startswith("kind_") and abs(c["term"]) > 0.1 for r in got for c in r["contributions"])


def test_leaf_integrals_on_paths_that_repeat_features():
    leaf = AT.Leaf(2.0, (0, 2, 3), (-np.inf, 1.0, -1.0), (0.5, np.inf, 1.0), (0.25, 0.5, 0.8))
    x = np.array([[0.0, 9.0, 2.0, 0.0], [1.0, 9.0, 2.0, 0.0], [1.0, 9.0, 0.0, 5.0]])
    got = AT.shapley_terms(x, [leaf])
    for row, terms in zip(x, got):
        passes = {f: float(lo < row[f] <= hi) for f, lo, hi in zip(leaf.features, leaf.lo, leaf.hi)}
        share = dict(zip(leaf.features, leaf.share))
        value = lambda known: 2.0 * math.prod(passes[f] if f in known else share[f] for f in leaf.features)
        for i in leaf.features:
            rest = [f for f in leaf.features if f != i]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value({*s, i}) - value(set(s))) for k in range(3) for s in combinations(rest, k))
            assert terms[i] == pytest.approx(want, abs=1e-12)
        assert terms[1] == 0


def test_terms_from_tables_equal_those_worked_out_by_rows(monkeypatch):
    """Every leaf's terms are looked up by which features pass; leaves with more features than a table may have are worked out, with the same result."""
    rng = np.random.default_rng(5)
    leaves = []
    for m in (0, 1, 3, 5, 6):
        lo = rng.normal(-0.5, 0.5, m)
        leaves.append(AT.Leaf(float(rng.normal()), tuple(range(m)), tuple(lo), tuple(lo + 1.0), tuple(rng.uniform(0.1, 0.9, m))))
    x = rng.normal(size=(50, 6))
    x[0, 0], x[1, 1] = np.inf, -np.inf
    tables = AT.leaf_tables(leaves)
    assert [None if t is None else t.shape for t in tables] == [None, (1, 2), (3, 8), (5, 32), (6, 64)]
    looked_up = AT.shapley_terms(x, leaves, tables)
    monkeypatch.setattr(AT, "TABLE_FEATURES", 4)
    assert [t is None for t in AT.leaf_tables(leaves)] == [True, False, False, True, True]
    np.testing.assert_allclose(looked_up, AT.shapley_terms(x, leaves), rtol=1e-12, atol=1e-12)
    monkeypatch.setattr(AT, "TABLE_FEATURES", 0)
    np.testing.assert_allclose(looked_up, AT.shapley_terms(x, leaves), rtol=1e-12, atol=1e-12)
