import random

from pyspark.sql import functions as F

from pitgauge.operators.prefix import running_sums


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0.5, 1.5, 2.5]), rng.choice([None, 0, 3, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k double, v long").repartition(5)
    got = running_sums(df, [F.col("k"), F.col("id")], {"total": F.col("v"), "place": F.lit(1)}, parts=7).collect()
    want, total = {}, 0
    for place, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1):
        total += v or 0
        want[i] = (total, place)
    assert {r["id"]: (r["total"], r["place"]) for r in got} == want


def test_running_sums_of_hot_and_empty_tables(spark):
    same = spark.range(300).selectExpr("1 AS k", "2 AS v")
    assert sorted(r["s"] for r in running_sums(same, [F.col("k")], {"s": F.col("v")}).collect()) == list(range(2, 602, 2))
    assert running_sums(same.limit(0), [F.col("k")], {"s": F.col("v")}).count() == 0
