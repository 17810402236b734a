"""Route search against a plain search on random graphs with many equal costs."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from pitgauge.operators import routing as RT


def _plain(edges, source):
    """Least (cost, path) per node by a priority queue that carries whole paths."""
    out, heap = {}, [(0.0, [source])]
    while heap:
        cost, path = heapq.heappop(heap)
        if path[-1] in out:
            continue
        out[path[-1]] = (cost, path)
        for nxt, w in edges.get(path[-1], ()):
            if nxt not in out:
                heapq.heappush(heap, (cost + w, path + [nxt]))
    return out


def _random_roads(seed, n, m, lengths):
    rng = random.Random(seed)
    pairs = {}
    while len(pairs) < m:
        a, b = rng.sample(range(n), 2)
        pairs[(min(a, b), max(a, b))] = float(rng.choice(lengths))
    return [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()]


def _adjacent(roads):
    out = {}
    for a, b, w in roads:
        out.setdefault(a, []).append((b, w))
    return out


@pytest.mark.parametrize("seed,hot,rounds", [(1, 10_000, 1), (2, 3, 4)])
def test_costs_and_smallest_paths(spark, seed, hot, rounds):
    roads = _random_roads(seed, 40, 90, [1, 2, 3])
    asked = [(s, t) for s in (0, 7, 21) for t in range(40)] + [(0, 5), (0, 5), (None, 3), (3, None), (3, 999)]
    edges = spark.createDataFrame(roads, "src long, dst long, length double")
    req = spark.createDataFrame(asked, "src long, dst long")
    rows = RT.cheapest_paths(edges, req, {"length": F.col("length"), "double": F.col("length") * 2}, hot_degree=hot, rounds_per_stage=rounds).collect()
    got = {(r.metric, r.src, r.dst): (r.cost, r.path) for r in rows}
    assert len(got) == len(rows)
    want = {}
    for s in (0, 7, 21):
        for t, (cost, path) in _plain(_adjacent(roads), s).items():
            want["length", s, t], want["double", s, t] = (cost, path), (cost * 2, path)
    assert got == want


def test_roads_without_length(spark):
    roads = _random_roads(5, 25, 60, [0, 0, 1, 2])
    lengths = {(a, b): w for a, b, w in roads}
    edges = spark.createDataFrame(roads, "src long, dst long, length double")
    req = spark.createDataFrame([(0, t) for t in range(25)], "src long, dst long")
    rows = RT.cheapest_paths(edges, req, {"length": F.col("length")}).collect()
    want = _plain(_adjacent(roads), 0)
    assert {r.dst: r.cost for r in rows} == {t: c for t, (c, _) in want.items()}
    for r in rows:
        assert r.path[0] == 0 and r.path[-1] == r.dst and len(set(r.path)) == len(r.path)
        assert sum(lengths[p] for p in zip(r.path, r.path[1:])) == r.cost


def test_no_requests_and_no_roads(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", None)], "src string, dst string, length double")
    none = spark.createDataFrame([], "src string, dst string")
    some = spark.createDataFrame([("a", "b"), ("a", "c"), ("z", "z")], "src string, dst string")
    cost = {"length": F.col("length")}
    assert RT.cheapest_paths(edges, none, cost).count() == 0
    assert {(r.src, r.dst, tuple(r.path)) for r in RT.cheapest_paths(edges, some, cost).collect()} == {("a", "b", ("a", "b")), ("z", "z", ("z",))}
    assert {(r.dst, r.cost) for r in RT.cheapest_paths(edges.where("false"), some, cost).collect()} == {("z", 0.0)}


def test_states_carry_no_paths(spark, monkeypatch):
    written = []
    cut = RT.cut_lineage
    monkeypatch.setattr(RT, "cut_lineage", lambda df: written.append(df.schema) or cut(df))
    edges = spark.createDataFrame(_random_roads(3, 12, 20, [1, 2]), "src long, dst long, length double")
    req = spark.createDataFrame([(0, 5)], "src long, dst long")
    RT.cheapest_paths(edges, req, {"length": F.col("length")})
    assert len(written) > 5 and all("array" not in schema.simpleString() for schema in written[:-1])  # the last is the result


def test_requests_between_separate_parts_are_left_out_before_the_search(spark):
    """Two long chains: a target on the other one, or off the roads, is not searched for, so the search ends after a few rounds."""
    chain = [(f"{c}{i:03d}", f"{c}{i + 1:03d}", 1.0) for c in "ab" for i in range(120)]
    edges = spark.createDataFrame(chain + [(b, a, w) for a, b, w in chain], "src string, dst string, length double")
    asked = [("a000", "b001"), ("a000", "a002"), ("b007", "a119"), ("a001", "zz"), ("zz", "zz"), ("b003", "b003"), (None, "a001")]
    requests = spark.createDataFrame(asked, "src string, dst string")
    wanted = spark.createDataFrame([("m", s, t) for s, t in asked[:-1]], "metric string, source string, target string")
    roads = edges.select(F.lit("m").alias("metric"), F.col("src").alias("node"), "dst", F.col("length").alias("w"))
    assert {(r.source, r.target) for r in RT._connected(roads, wanted).collect()} == {("a000", "a002"), ("zz", "zz"), ("b003", "b003")}
    got = {(r.src, r.dst): (r.cost, r.path) for r in RT.cheapest_paths(edges, requests, {"m": F.col("length")}).collect()}
    assert got == {("a000", "a002"): (2.0, ["a000", "a001", "a002"]), ("zz", "zz"): (0.0, ["zz"]), ("b003", "b003"): (0.0, ["b003"])}


def test_smallest_paths_through_many_cells_and_windows(spark):
    """A grid of equal roads, where almost every path has equals, in cells of a few roads and windows of a few nodes."""
    name = lambda i, j: f"{(7 * i + 3 * j) % 10}{i}{j}"
    at = [(i, j) for i in range(6) for j in range(6)]
    half = [(name(i, j), name(i + a, j + b), 1.0 + (i * j) % 2) for i, j in at for a, b in ((0, 1), (1, 0)) if i + a < 6 and j + b < 6]
    roads = half + [(b, a, w) for a, b, w in half]
    edges = spark.createDataFrame(roads, "src string, dst string, length double")
    asked = [(s, name(*t)) for s in (name(0, 0), name(3, 2)) for t in at]
    requests = spark.createDataFrame(asked, "src string, dst string")
    rows = RT.cheapest_paths(edges, requests, {"m": F.col("length")}, hot_degree=3, cell_roads=30, window_nodes=9).collect()
    want = {(s, t): found for s in (name(0, 0), name(3, 2)) for t, found in _plain(_adjacent(roads), s).items()}
    assert len(rows) == 72 and {(r.src, r.dst): (r.cost, r.path) for r in rows} == want


def test_written_stages_do_not_follow_the_roads_of_a_path(spark, monkeypatch):
    """A chain of 240 roads: its states are exchanged between cells, not after every few roads."""
    written = []
    cut = RT.cut_lineage
    monkeypatch.setattr(RT, "cut_lineage", lambda df: written.append(1) or cut(df))
    chain = [(i, i + 1, 1.0) for i in range(240)]
    edges = spark.createDataFrame(chain + [(b, a, w) for a, b, w in chain], "src long, dst long, length double")
    requests = spark.createDataFrame([(0, 240), (100, 7)], "src long, dst long")
    rows = RT.cheapest_paths(edges, requests, {"m": F.col("length")}).collect()
    assert {(r.src, r.dst): (r.cost, r.path) for r in rows} == {(0, 240): (240.0, list(range(241))), (100, 7): (93.0, list(range(100, 6, -1)))}
    assert len(written) < 30


def test_windows_of_cost_are_written_once(spark):
    """A percentile that is worked out again can come out differently, and a node would then be looked for in another window."""
    states = spark.range(3000).select(F.lit("m").alias("metric"), (F.col("id") % 3).alias("source"), F.col("id").alias("node"), F.rand(1).alias("cost"))
    ends, n = RT._windows(states, 100)
    assert n == 10 and ends.where(F.size("ends") == 9).count() == 3 and ends.inputFiles()
    assert "percentile" not in ends._jdf.queryExecution().optimizedPlan().toString()


def _chain(spark, n):
    chain = spark.range(n - 1)
    return chain.select(F.col("id").alias("node"), (F.col("id") + 1).alias("dst")).unionByName(chain.select((F.col("id") + 1).alias("node"), F.col("id").alias("dst"))).select(
        F.lit("m").alias("metric"), "node", "dst", F.lit(1.0).alias("w"))


def test_a_source_with_near_targets_stays_near(spark):
    wanted = spark.range(0, 300, 3).select(F.lit("m").alias("metric"), F.col("id").alias("source"), F.inline(F.array(*[F.struct((F.col("id") + d).alias("target")) for d in (0, 2)])))
    reached = RT._distances(_chain(spark, 400), wanted, 10_000, 4)
    assert reached.count() <= 100 * 5
    assert reached.where("cost <> abs(node - source) or round <> abs(node - source)").isEmpty()
    assert reached.where("node = source + 2").count() == 100


def test_roads_are_copied_for_states_and_not_for_sources(spark, monkeypatch):
    """A task that has found enough leaves the rest to the next stage, where its sources are dealt anew."""
    one_each = spark.range(1000).select(F.lit("m").alias("metric"), F.col("id").alias("source"), F.col("id").alias("node"))
    assert [tuple(r) for r in RT._parts(one_each).collect()] == [("m", 0, 8)]
    monkeypatch.setattr(RT, "_TASK_STATES", 100)
    assert [tuple(r) for r in RT._parts(one_each).collect()] == [("m", 0, 10)]
    monkeypatch.setattr(RT, "_TASK_FINDS", 20)
    monkeypatch.setattr(RT, "_PLACES", 300)
    wanted = spark.range(7).select(F.lit("m").alias("metric"), F.col("id").alias("source"), F.lit(99).cast("long").alias("target"))
    reached = RT._distances(_chain(spark, 100), wanted, 10_000, 4)
    assert reached.where("cost <> abs(node - source)").isEmpty() and reached.where("node = 99").count() == 7
    assert reached.count() == 700
