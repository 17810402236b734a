"""MinHash, components and the embedding join against plain versions."""

import random

import numpy as np
import pytest

from pitgauge.llm import ego_join, minhash
from pitgauge.llm.graph import connected_components


def roots(n, edges):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    edges = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(sets), edges)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 240)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = roots(240, edges)
    assert got == {k: low[k] for e in edges if e[0] != e[1] for k in e}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_sketch_agrees_as_the_similarity_and_fills_all_bins():
    rng = np.random.default_rng(3)
    for shared, own in ((800, 100), (400, 300), (9, 1), (1, 0)):
        total, places = 0, 0
        for _ in range(20):
            x = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
            a, b = minhash.sketch(x[:shared + own]), minhash.sketch(np.concatenate([x[:shared], x[shared + own:]]))
            assert (a != ~np.uint64(0)).all()
            total, places = total + int((a == b).sum()), places + len(a)
        want = shared / (shared + 2 * own)
        assert abs(total / places - want) < 0.06


def test_blocks_of_rounds_dont_change_the_sketch(monkeypatch):
    items = np.random.default_rng(1).integers(0, 1 << 63, 3, dtype=np.uint64)
    whole = minhash.sketch(items)
    monkeypatch.setattr(minhash.np, "log", lambda x: 0.01)
    assert np.array_equal(minhash.sketch(items), whole)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 20, 60, 120]))]
        for _ in range(rng.choice([1, 4, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    hub = [rng.choice(vocab) for _ in range(80)]
    texts += [" ".join(hub[:k] + [rng.choice(vocab)] + hub[k + 1:]) for k in range(80)] + [None, "", " \t", "ABC d", "abc D"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, words=4, percent=80).collect()}
    n, low = plain_components(texts, 4, 80)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert [got[i]["component_id"] for i in range(len(texts))] == low
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    same = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, words=4, percent=100).collect()}
    assert [same[i] for i in range(len(texts))] == plain_components(texts, 4, 100)[1]


def test_chain_within_one_band_is_found(spark):
    """Two ends that aren't similar are one component by what lies between."""
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(0, 60, 3):
        texts.append(" ".join([f"x{i}" for i in range(k)] + base[k:]))
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    n, low = plain_components(texts, 5, 80)
    assert [r["component_id"] - 100 for r in minhash.near_duplicates(df).orderBy("doc_id").collect()] == low


def test_minhash_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, words=4).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[5]["n_shingles"] == 0 and by[2]["kept"] and by[3]["kept"]
    assert by[4]["n_shingles"] == 1 and by[6]["n_shingles"] == 1
    kept = minhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 10
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.drop_near_duplicates(no_docs).count() == 0


def plain_links(rows, threshold):
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is None or la != lb or not a or not b or len(a) != len(b) or None in a or None in b:
                continue
            x, y = np.array(a, float), np.array(b, float)
            if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
                continue
            x, y = x / np.abs(x).max(), y / np.abs(y).max()  # so that squares neither vanish nor overflow
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[i].append(j)
                links[j].append(i)
    return [len(x) for x in links], roots(n, [(i, j) for i in range(n) for j in links[i]])


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(12):
        base = rng.normal(size=8)
        for _ in range(rng.integers(1, 30)):
            rows.append((base + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.3])).tolist())
    rows = [(i, v, int(rng.integers(0, 2)) if i % 11 else None) for i, v in enumerate(rows)]
    n = len(rows)
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * 8, [nan] + [1.0] * 7, [inf] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], [1e-200] + [0.0] * 7, [1e200] + [0.0] * 7, [3.0] + [-0.0] * 7]
    return rows + [(n + i, v, 1) for i, v in enumerate(odd)]


@pytest.mark.parametrize("interval,leaf", [(2048, 128), (16, 4)])
def test_join_equals_brute_force(spark, vectors, monkeypatch, interval, leaf):
    monkeypatch.setattr(ego_join, "INTERVAL", interval)
    monkeypatch.setattr(ego_join, "LEAF", leaf)
    df = spark.createDataFrame([(*r, 0, "n") for r in vectors], "vec_id long, embedding array<double>, label int, m int, id string").repartition(3)
    got = {r["vec_id"]: r for r in ego_join.epsilon_join(df, 0.93).collect()}
    n, low = plain_links(vectors, 0.93)
    assert all(got[i]["n_links"] == n[i] and got[i]["component_id"] == low[i] for i in range(len(vectors)))
    assert len(got) == len(vectors) and all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_vectors_of_another_length_link_over_intervals(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "INTERVAL", 4)
    rows = [(i, [1.0 + i % 3 * 0.01, 2.0, (i + 1.0) * 50][:2] if i % 2 else [float(i + 1)] * 3, 1) for i in range(40)]
    rows = [(i, [x * (1 + i) for x in v], lab) for i, v, lab in rows]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ego_join.epsilon_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (19, i % 2) for i in range(40)}


def test_join_of_copies_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(i, [1.0, 2.0], 3) for i in range(50)] + [(60, [1.0, 2.0], 4), (61, None, None)], schema)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ego_join.epsilon_join(df).collect()}
    assert got == {**{i: (49, 0) for i in range(50)}, 60: (0, 60), 61: (0, 61)}
    assert ego_join.epsilon_join(spark.createDataFrame([], schema)).count() == 0
    assert ego_join.epsilon_join(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], schema)).count() == 2


def test_bands_follow_from_the_similarity():
    assert minhash.band_plan(80) == (40, 5) and minhash.least_bits(80) == 155 and minhash.least_bits(100) == 200
    for percent in range(20, 101, 5):
        bands, rows = minhash.band_plan(percent)
        assert bands * rows <= minhash.BINS and (1 - (percent / 100) ** rows) ** bands <= minhash.MISS
    for percent in (0, 3, 101):
        with pytest.raises(ValueError):
            minhash.band_plan(percent)


@pytest.mark.parametrize("percent", [50, 65, 90])
def test_other_similarities_find_all_links(spark, percent):
    """Pairs of about the wanted similarity, each apart from all others."""
    rng = random.Random(percent)
    texts = []
    for k in range(120):
        base = [f"p{k}w{i}" for i in range(160)]
        copy, lost = list(base), round(160 * (1 - percent / 100) / (1 + percent / 100)) + rng.choice([-2, -1, 0, 1])
        copy[160 - max(0, lost):] = [f"q{k}w{i}" for i in range(max(0, lost))]
        texts += [" ".join(base), " ".join(copy)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    low = plain_components(texts, 3, percent)[1]
    assert 40 < sum(low[i] != i for i in range(len(texts))) < 120
    assert [r["component_id"] for r in minhash.near_duplicates(df, words=3, percent=percent).orderBy("doc_id").collect()] == low


def test_repeated_rows_stay_in_proportion(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-3] + ["x", "y", "z"]))] * 3_000 + [(3, "something else")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=4).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3_000), (2, 1, 3_000), (3, 3, 1)]
