"""Source mixing against a plain version that shares the excess again and again."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pitgauge.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), epochs=3):
    """source -> target; excess over the cap is reshared by weight until no source is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > epochs * sizes[s]}
        if not above:
            target.update({s: left * weight[s] / total for s in open_})
            break
        target.update({s: float(epochs * sizes[s]) for s in above})
        left -= sum(epochs * sizes[s] for s in above)
        open_ -= above
    return target


def plain_taken(rows, targets, sizes):
    """[(id, taken)] of rows (id, source, size, quality weight)."""
    out = []
    for source in sizes:
        members = []
        for i, s, n, w in rows:
            if s == source:
                u = (int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                members.append((-math.log(u) / w if w and w > 0 else math.inf, -1 if i is None else i, n))
        k = math.floor(targets[source] / sizes[source]) if sizes[source] else 0
        rest = math.floor(targets[source] - k * sizes[source] + 1e-9)
        for _, i, n in sorted(members):
            part = min(max(rest, 0), n)
            rest -= n
            out.append((i, k * n + part))
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, words long, q double").repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_plain_mix(spark, seed):
    rng = random.Random(seed)
    sources = [None, "b", "a", "Z", "é", "src10", "src9"][:rng.randint(1, 7)]
    rows = [(i, rng.choice(sources + sources[:1] * 3), rng.choice([0, 1, 7, 100, 5_000]), rng.choice([0.25, 1.0, 3.0])) for i in range(80)]
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets = plain_targets(sizes)
    got = mixing.plan_mix(documents(spark, rows), F.col("words"), F.col("q")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]], abs=1e-6) and r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - targets[s]) <= 1
    if all(abs(t - round(t)) > 1e-6 for t in targets.values()):
        assert sorted((r["doc_id"], r["taken"]) for r in got) == plain_taken(rows, targets, sizes)


def test_caps_are_reshared(spark):
    """c weighs most but has few words: it stops at three times them, then b stops too, and a takes the rest."""
    rows = [(i, "a", 10, 1.0) for i in range(100)] + [(200, "b", 30, 1.0), (201, "c", 5, 1.0)]
    got = {r["source"]: r["target"] for r in mixing.plan_mix(documents(spark, rows), F.col("words"), F.col("q")).collect()}
    assert got == {"a": 1035 - 90 - 15, "b": 90, "c": 15}


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, "a", 10, 4.0 if i % 2 else 1.0) for i in range(4_000)] + [(9_000, "b", 39_000, 1.0)]
    got = mixing.plan_mix(documents(spark, rows), F.col("words"), F.col("q")).where("source = 'a'")
    share = {r["odd"]: r["n"] for r in got.where("taken > 0").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.count("*").alias("n")).collect()}
    assert share[1] > 1.4 * share[0]


def test_epochs_and_words_of_the_mixture(spark):
    docs = spark.createDataFrame([(1, "a", "one two three"), (2, "b", "x y"), (3, "c", None), (4, "c", " \n")], "doc_id long, source string, text string")
    plan = mixing.plan_mix(docs, mixing.word_count(F.col("text")), F.lit(1.0))
    taken = {r["doc_id"]: r["taken"] for r in plan.collect()}
    assert taken == {1: 1, 2: 3, 3: 0, 4: 0} or sum(taken.values()) in (4, 5)
    rows = mixing.mixture(docs, plan).collect()
    assert {r["doc_id"]: sum(x["n_words"] for x in rows if x["doc_id"] == r["doc_id"]) for r in rows} == {k: v for k, v in taken.items() if v}
    assert all(r["n_words"] <= len(r["text"].split()) for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("source", F.col("lang"))
    size = mixing.word_count(F.col("text"))
    got = mixing.plan_mix(docs, size, F.col("score")).collect()
    want = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.select("doc_id", "text").collect()}
    assert len(got) == 10 and all(r["size"] == want[r["doc_id"]] for r in got)
    assert abs(sum(r["taken"] for r in got) - sum(r["size"] for r in got)) <= len({r["source"] for r in got})
    again = mixing.plan_mix(docs.repartition(4), size, F.col("score")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.plan_mix(no_docs.withColumn("source", F.lit(None).cast("string")), size, F.lit(None).cast("double")).count() == 0
    nothing = mixing.plan_mix(docs.where("doc_id in (2, 3)"), size, F.lit(1.0)).collect()
    assert [(r["target"], r["taken"]) for r in nothing] == [(0.0, 0)] * 2
    bad = spark.createDataFrame([(i, "a", w) for i, w in enumerate([1.0, None, 0.0, -2.0, float("nan")])], "doc_id long, source string, w double")
    draws = {r["doc_id"]: r["k"] for r in bad.select("doc_id", mixing.exponential_key(F.col("doc_id"), F.col("w")).alias("k")).collect()}
    assert draws[0] < math.inf and all(draws[i] == math.inf for i in (1, 2, 3, 4))
