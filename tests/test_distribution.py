"""Distribution distance against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pitgauge.operators import distribution as D


def plain(a, b):
    key = lambda x: (math.isnan(x), x)
    cdf = lambda xs, v: sum(key(x) <= key(v) for x in xs) / len(xs)
    return max(abs(cdf(a, v) - cdf(b, v)) for v in [*a, *b]) if a and b else None


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_plain_distance(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in [None, "x", "y", "z"]:
        for _ in range(rng.choice([40, 150])):
            first = rng.random() < 0.4
            rows.append((g, float(rng.choice([rng.randint(0, 5), rng.gauss(0.5 if first and g == "y" else 0, 1)])), first))
    rows += [("only", 1.0, True), ("only", 2.0, True), ("x", None, True), ("x", 3.0, None), ("x", float("nan"), True)]
    df = spark.createDataFrame(rows, "g string, v double, first boolean").repartition(5)
    got = {r["g"]: r for r in D.ks_distance(df, "v", "first", ["g"], parts=6).collect()}
    assert set(got) == {None, "x", "y", "z", "only"} and got["only"]["distance"] is None and got["only"]["differs"] is None
    for g in (None, "x", "y", "z"):
        a, b = ([v for k, v, f in rows if k == g and v is not None and f is s] for s in (True, False))
        assert (got[g]["n_first"], got[g]["n_second"]) == (len(a), len(b))
        assert got[g]["distance"] == pytest.approx(plain(a, b), abs=1e-12)
        assert got[g]["differs"] == (plain(a, b) > 1.628 * math.sqrt((len(a) + len(b)) / (len(a) * len(b))))


def test_whole_tables_hot_values_and_shifts(spark):
    same = spark.range(4_000).select((F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2 == 0).alias("first"))
    r = D.ks_distance(same, "v", "first", parts=3).first()
    assert r["n_first"] == r["n_second"] == 2_000 and r["distance"] < 0.01 and not r["differs"]
    hot = spark.range(3_000).select(F.when(F.col("id") < 2_900, 1.0).otherwise(2.0).alias("v"), (F.col("id") % 2 == 0).alias("first"))
    assert not D.ks_distance(hot, "v", "first", parts=3).first()["differs"]
    moved = same.withColumn("v", F.col("v") + F.when(F.col("first"), 3.0).otherwise(0.0))
    assert D.ks_distance(moved, "v", "first", parts=3).first()["differs"]
    assert D.ks_distance(same.limit(0), "v", "first").first()["distance"] is None
    assert D.ks_distance(same.limit(0).withColumn("g", F.lit("a")), "v", "first", ["g"]).count() == 0
