"""Batch routing: road graph checks, cheapest paths for many requests, comparison, waypoints."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgauge.functions import scoring as S
from pitgauge.operators.components import connected_components
from pitgauge.session import cut_lineage


def road_rejects(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """Roads with an unknown endpoint or an invalid length, with the reason."""
    known = nodes.select(F.col("node"))
    ends = roads.select("road_id", F.explode(F.array("src", "dst")).alias("node"))
    unknown = ends.join(known, "node", "left_anti").select("road_id", F.lit("unknown endpoint").alias("reason")).distinct()
    bad = roads.where(F.col("length").isNull() | F.isnan("length") | (F.col("length") < 0)).select(
        "road_id", F.lit("invalid length").alias("reason"))
    return unknown.unionByName(bad)


def build_edges(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """Directed edges of the undirected graph: valid roads, the latest per pair, both directions.

    A road without adjacent zones is adjacent to its endpoints.
    """
    good = roads.join(road_rejects(nodes, roads).select("road_id").distinct(), "road_id", "left_anti")
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    adj = F.coalesce("adjacent", F.array("src", "dst"))
    latest = F.max_by(F.struct("length", adj.alias("adjacent")), F.col("road_id"))
    one = good.groupBy(a.alias("a"), b.alias("b")).agg(latest.alias("e"))
    ends = F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                            F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return one.select(F.col("e.length").alias("length"), F.col("e.adjacent").alias("adjacent"), ends)


def with_worst_risk(edges: DataFrame, risk: DataFrame) -> DataFrame:
    """Largest risk of the zones beside each edge; NULL when any of them has none."""
    ex = edges.select("src", "dst", F.explode("adjacent").alias("node"))
    per = ex.join(risk, "node", "left").groupBy("src", "dst").agg(
        F.max("risk").alias("_m"), F.count_if(F.col("risk").isNull()).alias("_missing"))
    worst = per.select("src", "dst", F.when(F.col("_missing") == 0, F.col("_m")).alias("worst"))
    return edges.join(worst, ["src", "dst"])


def edges_without_risk(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("worst").isNull()).select("src", "dst", F.lit("missing risk").alias("reason"))


def cheapest_paths(edges: DataFrame, requests: DataFrame, costs: Mapping[str, Column], hot_degree: int = 10_000,
                   rounds_per_stage: int = 4, cell_roads: int = 200_000, window_nodes: int = 50_000) -> DataFrame:
    """Cheapest path per (metric, request) for several cost metrics in one run; of equal costs the smallest path.

    Requests between separate parts of the graph are left out first (``_connected``). Nodes then get numbers in their order, and cells of
    neighbouring numbers with about ``cell_roads`` roads. ``_distances`` relaxes roads until no cost improves, inside a cell without a
    shuffle. ``_used`` keeps the roads of cheapest paths. The smallest cheapest paths of a source form a tree, for the start of such a
    path is one itself: ``_tree`` finds it by windows of cost of about ``window_nodes`` nodes, ``_walk_back`` follows it from the targets.
    Paths are put together once, in the result.

    A road without length needs a rule against going round in circles: it is used only towards the node that takes more roads to
    reach. A request from a node to itself has that node as its path; requests with a null or without a path give no row; repeated requests
    give one. Roads whose cost is null aren't used.
    """
    labels = F.explode(F.array(*[F.lit(m) for m in costs])).alias("metric")
    roads = cut_lineage(edges.select(F.col("src").alias("node"), "dst", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), c.alias("w")) for m, c in costs.items()]))).where(F.col("w").isNotNull()))
    wanted = cut_lineage(requests.select(labels, F.col("src").alias("source"), F.col("dst").alias("target"))
                         .where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct())
    wanted = _connected(roads, wanted)
    numbers = _numbers(roads, wanted, max(1, -(-roads.count() // (cell_roads * max(1, len(costs))))))
    roads, wanted = cut_lineage(_numbered(roads, numbers, "node", "dst")), cut_lineage(_numbered(wanted, numbers, "source", "target"))
    reached = _distances(roads, wanted, hot_degree, rounds_per_stage)
    answered = cut_lineage(reached.withColumnRenamed("node", "target").join(wanted, _REQUEST, "left_semi"))
    windows = _windows(reached, window_nodes)
    tree = _tree(_used(roads, reached), wanted, windows)
    chosen = _walk_back(tree, answered, windows)
    named = numbers.select(F.col("number").alias("node"), F.col("node").alias("name"))
    steps = chosen.join(named, "node").groupBy(*_REQUEST).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "name"))), lambda x: x["name"]).alias("path"))
    return cut_lineage(steps.join(answered, _REQUEST).select("metric", F.element_at("path", 1).alias("src"), F.element_at("path", -1).alias("dst"), "cost", "path"))


_STATE = ["metric", "source", "node"]
_REQUEST = ["metric", "source", "target"]
#: A cell's tasks each get a copy of its roads: one for every few sources up to so many, more only for so many states.
_SOURCES, _PARTS, _TASK_STATES = 4, 8, 400_000
#: States of the sources that a task relaxes at a time, whether met or not, and states after which it leaves the rest to the next stage.
_PLACES, _TASK_FINDS = 500_000, 1_000_000
#: Rounds inside a cell for each of ``rounds_per_stage``; what is left over goes on in the next stage.
_INNER_ROUNDS = 64
#: What a row that comes to a cell is: a road, a state known there, a state that is new there, a target (its round is the number of its source's targets).
_ROAD, _HAD, _COME, _WANT = 0, 1, 2, 3
_NO_BOUND = float("inf")


def _connected(roads: DataFrame, wanted: DataFrame) -> DataFrame:
    """The requests whose ends roads connect in either direction, and those from a node to itself: no others can have a path.

    The search for a target that cannot be reached would otherwise go on through all that its source can reach, once for each such source.
    """
    at = lambda c: F.struct("metric", F.col(c).alias("node"))
    parts = cut_lineage(connected_components(roads.select(at("node").alias("a"), at("dst").alias("b")))
                        .select("node.metric", "node.node", F.col("component.node").alias("part")))
    begin = parts.select("metric", F.col("node").alias("source"), "part")
    end = parts.select("metric", F.col("node").alias("target"), "part")
    linked = wanted.join(begin, ["metric", "source"]).join(end, ["metric", "target", "part"]).select(*_REQUEST)
    return cut_lineage(linked.unionByName(wanted.where(F.col("source") == F.col("target")).select(*_REQUEST)).distinct())


def _numbers(roads: DataFrame, wanted: DataFrame, cells: int) -> DataFrame:
    """(node, number) in the order of the nodes; the upper bits of a number are its cell, a range of nodes."""
    ends = roads.select(F.explode(F.array("node", "dst")).alias("node")).unionByName(wanted.select(F.explode(F.array("source", "target")).alias("node")))
    nodes = cut_lineage(ends.where(F.col("node").isNotNull()).distinct())
    in_order = nodes.repartitionByRange(cells, "node").sortWithinPartitions("node")
    return cut_lineage(in_order.select("node", F.monotonically_increasing_id().alias("number")))


def _numbered(rows: DataFrame, numbers: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.withColumnRenamed(c, "_name").join(numbers.select(F.col("node").alias("_name"), F.col("number").alias(c)), "_name").drop("_name")
    return rows


def _cell(c: str) -> Column:
    return F.shiftright(c, 33)


def _roads_by_cell(roads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The roads inside a cell, with the cell, and those from one cell to another."""
    border = _cell("node") != _cell("dst")
    return cut_lineage(roads.where(~border).select("metric", _cell("node").alias("cell"), "node", "dst", "w")), cut_lineage(roads.where(border))


def _parts(states: DataFrame) -> DataFrame:
    """(metric, cell, parts): the tasks that a cell's states are dealt to by their source, so that copies of its roads grow with the states and not with the sources."""
    counts = states.groupBy("metric", _cell("node").alias("cell"), "source").count().groupBy("metric", "cell").agg(F.count(F.lit(1)).alias("s"), F.sum("count").alias("n"))
    few = F.least(F.ceil(F.col("s") / _SOURCES), F.lit(_PARTS))
    return cut_lineage(counts.select("metric", "cell", F.greatest(few, F.ceil(F.col("n") / _TASK_STATES)).cast("int").alias("parts")))


def _states_in_cells(states: DataFrame, parts: DataFrame, kind: int) -> DataFrame:
    bound = "bound" if "bound" in states.columns else F.lit(_NO_BOUND).alias("bound")
    placed = states.withColumn("cell", _cell("node")).join(F.broadcast(parts), ["metric", "cell"])
    return placed.select("metric", "cell", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("part"), F.lit(kind).alias("kind"), "source", "node",
                         F.lit(0).cast("long").alias("dst"), "cost", "round", bound)


def _roads_in_cells(inner: DataFrame, busy: DataFrame) -> DataFrame:
    return inner.join(busy, ["metric", "cell"]).select(
        "metric", "cell", "part", F.lit(_ROAD).alias("kind"), F.lit(0).cast("long").alias("source"), "node", "dst", F.col("w").cast("double").alias("cost"),
        F.lit(0).alias("round"), F.lit(_NO_BOUND).alias("bound"))


def _distances(roads: DataFrame, wanted: DataFrame, hot_degree: int, rounds_per_stage: int) -> DataFrame:
    """Least cost per (metric, source, node) and the number of roads that first gave it.

    Each stage relaxes the roads inside the cells that new costs have come to, for some of the sources a task, and writes the states that
    improve; these are then extended by one road into other cells. A state dearer than the dearest answer its source still needs is not
    extended; a source whose targets are all in one cell has that bound there as soon as they are met. Lost executors cost one stage.
    """
    spark = roads.sparkSession
    inner, border = _roads_by_cell(roads)
    extend = _relaxation(border, hot_degree)
    targets = cut_lineage(wanted.select("metric", "source", F.col("target").alias("node"), F.lit(0.0).alias("cost")).join(
        wanted.groupBy("metric", "source").agg(F.count(F.lit(1)).cast("int").alias("round")), ["metric", "source"]))
    relax, shape = _relax_cell(_INNER_ROUNDS * rounds_per_stage), "metric string, source long, node long, cost double, round int, open boolean"
    fresh = cut_lineage(wanted.select("metric", "source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("round"), F.lit(_NO_BOUND).alias("bound")).distinct())
    files: list[str] = []
    while not fresh.isEmpty():
        known = [spark.read.schema(shape).parquet(*files).select(*_STATE)] if files else []
        come_to = F.broadcast(fresh.select("metric", _cell("node").alias("cell")).distinct())
        parts = _parts(reduce(DataFrame.unionByName, known, fresh.select(*_STATE)).withColumn("cell", _cell("node")).join(come_to, ["metric", "cell"], "left_semi"))
        rows = _states_in_cells(fresh, parts, _COME)
        busy = F.broadcast(rows.select("metric", "cell", "part").distinct())
        here = _states_in_cells(targets, parts, _WANT)
        if files:
            here = here.unionByName(_states_in_cells(spark.read.schema(shape).parquet(*files), parts, _HAD))
        rows = rows.unionByName(_roads_in_cells(inner, busy)).unionByName(here.join(busy, ["metric", "cell", "part"], "left_semi"))
        found = cut_lineage(rows.groupBy("metric", "cell", "part").applyInArrow(relax, shape))
        files = [*files, *found.inputFiles()]
        answers = spark.read.schema(shape).parquet(*files).withColumnRenamed("node", "target").join(wanted, _REQUEST, "left_semi")
        answers = answers.groupBy(*_REQUEST).agg(F.min("cost").alias("_cost"))
        bound = wanted.join(answers, _REQUEST, "left").groupBy("metric", "source").agg(
            F.when(F.count_if(F.col("_cost").isNull()) == 0, F.max("_cost")).alias("bound"))
        across = extend(found.select(*_STATE, "cost", "round")).withColumn("round", F.col("round") + 1)
        best = across.unionByName(found.where("open").select(*across.columns)).groupBy(*_STATE).agg(F.min(F.struct("cost", "round")).alias("s"))
        fresh = cut_lineage(best.select(*_STATE, "s.*").join(bound, ["metric", "source"]).withColumn("bound", F.coalesce("bound", F.lit(_NO_BOUND)))
                            .where(F.col("cost") <= F.col("bound")))
    if not files:
        return fresh.drop("bound")
    best = spark.read.schema(shape).parquet(*files).groupBy(*_STATE).agg(F.min(F.struct("cost", "round")).alias("s"))
    return cut_lineage(best.select(*_STATE, "s.cost", "s.round"))


def _relax_cell(rounds: int) -> Callable[[pa.Table], pa.Table]:
    """Relaxes the roads inside one cell for some sources, from the states that have come, until none improves or the rounds are used up.

    Returns the states that are better than those it had; ``open`` are those of the last round, not extended yet. Sources are taken a few at a
    time, ``_PLACES`` states at most; of more than ``_TASK_FINDS`` states in a task the rest is left open.
    """

    def better(at: np.ndarray, cost: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((hops, cost, at))
        first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
        return at[first], cost[first], hops[first]

    def relax(rows: pa.Table) -> pa.Table:
        kind, source, node, dst, cost, hops, bound = (rows[c].to_numpy() for c in ("kind", "source", "node", "dst", "cost", "round", "bound"))
        road = kind == _ROAD
        nodes, sources = np.unique(np.concatenate([node, dst[road]])), np.unique(source[kind == _COME])
        n = len(nodes)
        begin = np.searchsorted(nodes, node[road])
        order = np.argsort(begin, kind="stable")
        first = np.searchsorted(begin[order], np.arange(n + 1))
        end, w = np.searchsorted(nodes, dst[road])[order], cost[road][order]
        some = max(1, min(len(sources), _PLACES // n))
        least, fewest = np.full(some * n, np.inf), np.full(some * n, np.iinfo(np.int32).max, np.int32)
        before, before_hops = least.copy(), fewest.copy()

        def by_source(these: np.ndarray) -> tuple[np.ndarray, ...]:
            these = np.flatnonzero(these & np.isin(source, sources))
            of = np.searchsorted(sources, source[these])
            sort = np.argsort(of, kind="stable")
            these, of = these[sort], of[sort]
            return of, np.searchsorted(nodes, node[these]), cost[these], hops[these], bound[these]

        had, come, want = (by_source(kind == k) for k in (_HAD, _COME, _WANT))
        out, room = [], _TASK_FINDS
        for low in range(0, len(sources), some):
            high = min(low + some, len(sources))

            def part(given):
                x = slice(*np.searchsorted(given[0], (low, high)))
                return ((given[0][x] - low) * n + given[1][x], *(c[x] for c in given[2:]))

            at, c, h, _ = part(had)
            at, c, h = better(at, c, h)
            least[at], fewest[at] = before[at], before_hops[at] = c, h
            met = [at]
            places, _, all_of, _ = part(want)
            ends = np.flatnonzero(np.diff(places // n, prepend=-1))
            whole = np.diff(ends, append=len(places)) == all_of[ends]  # its targets are all in this cell
            most = np.full(high - low, np.inf)

            def bounded():
                if len(places):
                    of = places[ends] // n
                    most[of] = np.minimum(most[of], np.where(whole, np.maximum.reduceat(least[places], ends), np.inf))

            at, c, h, limit = part(come)
            np.minimum.at(most, at // n, limit)
            at, c, h = better(at, c, h)
            good = (c < least[at]) | ((c == least[at]) & (h <= fewest[at]))
            active = at[good]
            least[active], fewest[active] = c[good], h[good]
            met.append(active)
            finds, share = len(active), max(0, room) * (high - low) // (len(sources) - low)
            for _ in range(rounds):
                bounded()
                a = first[active % n]
                many = first[active % n + 1] - a
                of = np.repeat(active, many)
                leg = np.arange(len(of)) + np.repeat(a - np.cumsum(many) + many, many)
                at, c, h = of - of % n + end[leg], least[of] + w[leg], fewest[of] + 1
                good = ((c < least[at]) | ((c == least[at]) & (h < fewest[at]))) & (c <= most[at // n])
                at, c, h = better(at[good], c[good], h[good])
                finds += np.count_nonzero(np.isinf(least[at]))
                active = at
                least[active], fewest[active] = c, h
                met.append(active)
                if not len(active) or finds > share:
                    break
            room -= finds
            met = np.unique(np.concatenate(met))
            still = np.isin(met, active)
            new = np.flatnonzero((least[met] != before[met]) | (fewest[met] != before_hops[met]) | still)
            at = met[new]
            out.append((sources[low + at // n], nodes[at % n], least[at], fewest[at], still[new]))
            least[met] = before[met] = np.inf
            fewest[met] = before_hops[met] = np.iinfo(np.int32).max
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"metric": pa.repeat(rows["metric"][0], len(columns[0]))} | dict(zip(("source", "node", "cost", "round", "open"), columns)))

    return relax


def _used(roads: DataFrame, reached: DataFrame) -> DataFrame:
    """(metric, source, node, nxt) for the roads that cheapest paths use, with the cost of both ends; those inside a cell are found without a join."""
    inner, border = _roads_by_cell(roads)
    states = _states_in_cells(reached, _parts(reached), _HAD)
    rows = states.unionByName(_roads_in_cells(inner, F.broadcast(states.select("metric", "cell", "part").distinct())))
    inside = rows.groupBy("metric", "cell", "part").applyInArrow(_used_in_cell(), "metric string, source long, node long, nxt long, cost double, nxt_cost double")
    begin = reached.select(*_STATE, "cost", "round")
    end = reached.select("metric", "source", F.col("node").alias("nxt"), F.col("cost").alias("nxt_cost"), F.col("round").alias("nxt_round"))
    further = (F.col("cost") < F.col("nxt_cost")) | (F.col("round") < F.col("nxt_round"))
    across = begin.join(border.withColumnRenamed("dst", "nxt"), ["metric", "node"]).join(end, ["metric", "source", "nxt"])
    return inside.unionByName(across.where((F.col("cost") + F.col("w") == F.col("nxt_cost")) & further).select(*_STATE, "nxt", "cost", "nxt_cost"))


def _used_in_cell() -> Callable[[pa.Table], pa.Table]:
    def used(rows: pa.Table) -> pa.Table:
        kind, source, node, dst, cost, hops = (rows[c].to_numpy() for c in ("kind", "source", "node", "dst", "cost", "round"))
        road = kind == _ROAD
        nodes, sources = np.unique(np.concatenate([node, dst[road]])), np.unique(source[~road])
        n = len(nodes)
        begin = np.searchsorted(nodes, node[road])
        order = np.argsort(begin, kind="stable")
        first = np.searchsorted(begin[order], np.arange(n + 1))
        end, w = np.searchsorted(nodes, dst[road])[order], cost[road][order]
        state = np.searchsorted(sources, source[~road]) * n + np.searchsorted(nodes, node[~road])
        order = np.argsort(state)
        state, least, fewest = state[order], cost[~road][order], hops[~road][order]
        out = []
        for low in range(0, len(state), _PLACES // 5):
            here = state[low:low + _PLACES // 5]
            a = first[here % n]
            many = first[here % n + 1] - a
            b = np.repeat(np.arange(low, low + len(here)), many)
            leg = np.arange(len(b)) + np.repeat(a - np.cumsum(many) + many, many)
            to = state[b] - state[b] % n + end[leg]
            e = np.minimum(np.searchsorted(state, to), len(state) - 1)
            i = np.flatnonzero((state[e] == to) & (least[b] + w[leg] == least[e]) & ((least[b] < least[e]) | (fewest[b] < fewest[e])))
            b, e = b[i], e[i]
            out.append((sources[state[b] // n], nodes[state[b] % n], nodes[state[e] % n], least[b], least[e]))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"metric": pa.repeat(rows["metric"][0], len(columns[0]))} | dict(zip(("source", "node", "nxt", "cost", "nxt_cost"), columns)))

    return used


def _windows(reached: DataFrame, window_nodes: int) -> tuple[DataFrame, int]:
    """Per (metric, source) the costs at which windows end, so that each has about ``window_nodes`` nodes (more only at equal costs), and their number.

    The ends are written once: approximate percentiles come out differently when their parts arrive in another order, and a node has to stay in its window.
    """
    counts = reached.groupBy("metric", "source").count().agg(F.max("count")).first()[0] or 0
    n = max(1, -(-counts // window_nodes))
    at = [k / n for k in range(1, n)]
    ends = F.percentile_approx("cost", at, 10_000) if at else F.array().cast("array<double>")
    written = cut_lineage(reached.groupBy("metric", "source").agg(ends.alias("ends")).select("metric", "source", F.explode_outer("ends").alias("end")))
    return written.groupBy("metric", "source").agg(F.sort_array(F.collect_list("end")).alias("ends")), n


def _window(cost: str) -> Column:
    return F.size(F.filter("ends", lambda x: x < F.col(cost)))


def _tree(used: DataFrame, wanted: DataFrame, windows: tuple[DataFrame, int]) -> DataFrame:
    """(metric, source, node, prev, depth, win, prev_win): the last step of the smallest cheapest path to each node.

    Going through the roads in use depth first, smallest next node first, meets each node first by its smallest path. One window of cost is
    gone through at a time: roads that leave it keep their place in that order as a label and wait for the window they lead to.
    """
    ends, n = windows
    legs = used.join(ends, ["metric", "source"]).select(*_STATE, "nxt", _window("cost").alias("win"), _window("nxt_cost").alias("nxt_win"))
    legs = cut_lineage(legs)
    spark = used.sparkSession
    shape = "metric string, source long, node long, prev long, depth int, win int, prev_win int, label binary"
    begin = wanted.select("metric", "source").distinct().select(
        "metric", "source", F.col("source").alias("node"), F.lit(None).cast("long").alias("prev"), F.lit(1).alias("depth"), F.lit(0).alias("win"),
        F.lit(-1).alias("prev_win"), F.lit(b"").alias("label"))
    waiting = [cut_lineage(begin)]
    files: list[str] = []
    for k in range(n):
        here = reduce(DataFrame.unionByName, waiting).where(F.col("win") == k)
        rows = here.select(*_STATE, F.lit(None).cast("long").alias("nxt"), F.lit(None).cast("int").alias("nxt_win"), "prev", "depth", "prev_win", "label").unionByName(
            legs.where(F.col("win") == k).select(*_STATE, "nxt", "nxt_win"), allowMissingColumns=True)
        done = cut_lineage(rows.groupBy("metric", "source").applyInArrow(_depth_first(k), f"{shape}, met boolean"))
        files += done.inputFiles()
        waiting.append(done.where("NOT met").drop("met"))
    return spark.read.schema(f"{shape}, met boolean").parquet(*files).where("met").drop("label", "met")


def _depth_first(k: int) -> Callable[[pa.Table], pa.Table]:
    """One window of one source: nodes met in it (with their last step), and the first road to each node of a later window."""

    def visit(rows: pa.Table) -> pa.Table:
        legs = rows.filter(pc.is_valid(rows["nxt"])).sort_by([("node", "ascending"), ("nxt", "ascending")])
        nodes, nxt, later = legs["node"].to_numpy(), legs["nxt"].to_pylist(), legs["nxt_win"].to_pylist()
        starts = np.flatnonzero(np.diff(nodes, prepend=-1)).tolist()
        legs_of = dict(zip(nodes[starts].tolist(), zip(starts, [*starts[1:], len(nodes)])))
        come = rows.filter(pc.is_null(rows["nxt"])).select(["label", "node", "prev", "depth", "prev_win"]).sort_by("label").to_pylist()
        met, sent, out = set(), set(), []
        for r in come:
            if r["node"] in met:
                continue
            met.add(r["node"])
            out.append((r["node"], r["prev"], r["depth"], k, r["prev_win"], b"", True))
            legs_left, count = [(r["node"], r["depth"] + 1, iter(range(*legs_of.get(r["node"], (0, 0)))))], 0
            while legs_left:
                node, depth, left = legs_left[-1]
                for i in left:
                    to = nxt[i]
                    if later[i] > k:
                        if to not in sent:
                            sent.add(to)
                            out.append((to, node, depth, later[i], k, r["label"] + count.to_bytes(8, "big"), False))
                            count += 1
                    elif to not in met:
                        met.add(to)
                        out.append((to, node, depth, k, k, b"", True))
                        legs_left.append((to, depth + 1, iter(range(*legs_of.get(to, (0, 0))))))
                        break
                else:
                    legs_left.pop()
        node, prev, depth, win, prev_win, label, is_met = zip(*out) if out else ((),) * 7
        return pa.table({"metric": pa.repeat(rows["metric"][0], len(out)), "source": pa.repeat(rows["source"][0], len(out)), "node": pa.array(node, pa.int64()),
                         "prev": pa.array(prev, pa.int64()), "depth": pa.array(depth, pa.int32()), "win": pa.array(win, pa.int32()),
                         "prev_win": pa.array(prev_win, pa.int32()), "label": pa.array(label, pa.binary()), "met": pa.array(is_met, pa.bool_())})

    return visit


def _walk_back(tree: DataFrame, answered: DataFrame, windows: tuple[DataFrame, int]) -> DataFrame:
    """(request, node, depth) for the nodes of each request's path, from the last window of cost to the first."""
    ends, n = windows
    spark = tree.sparkSession
    shape = "metric string, source long, target long, node long, depth int, win int"
    at = [answered.join(ends, ["metric", "source"]).select(*_REQUEST, F.col("target").alias("node"), _window("cost").alias("win"))]
    files: list[str] = []
    for k in reversed(range(n)):
        here = reduce(DataFrame.unionByName, at).where(F.col("win") == k)
        steps = tree.where(F.col("win") == k).join(here.select("metric", "source").distinct(), ["metric", "source"], "left_semi")
        rows = here.select(*_REQUEST, "node").unionByName(steps.select(*_STATE, "prev", "depth", "prev_win"), allowMissingColumns=True)
        done = cut_lineage(rows.groupBy("metric", "source").applyInArrow(_follow(k), shape))
        files += done.inputFiles()
        at.append(done.where(F.col("depth") == 0).drop("depth"))
    return spark.read.schema(shape).parquet(*files).where("depth > 0").drop("win")


def _follow(k: int) -> Callable[[pa.Table], pa.Table]:
    """One window of one source: the nodes of its requests' paths in it, and (depth 0) where each goes on in an earlier window."""

    def follow(rows: pa.Table) -> pa.Table:
        steps, asked = rows.filter(pc.is_null(rows["target"])), rows.filter(pc.is_valid(rows["target"]))
        step = dict(zip(steps["node"].to_pylist(), zip(*(steps[c].to_pylist() for c in ("prev", "depth", "prev_win")))))
        target, node, depth, win = [], [], [], []
        for t, at in zip(asked["target"].to_pylist(), asked["node"].to_pylist()):
            in_window, many = k, len(node)
            while in_window == k:
                prev, d, in_window = step[at]
                node.append(at)
                depth.append(d)
                at = prev
            if in_window >= 0:
                node.append(at)
                depth.append(0)
            many = len(node) - many
            target += [t] * many
            win += [in_window] * many
        return pa.table({"metric": pa.repeat(rows["metric"][0], len(node)), "source": pa.repeat(rows["source"][0], len(node)), "target": pa.array(target, pa.int64()),
                         "node": pa.array(node, pa.int64()), "depth": pa.array(depth, pa.int32()), "win": pa.array(win, pa.int32())})

    return follow


def _relaxation(roads: DataFrame, hot_degree: int) -> Callable[[DataFrame], DataFrame]:
    """States extended by one edge; edges of hot nodes (at most E / hot_degree nodes) are salted."""
    columns = ["metric", "source", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), "round"]
    degree = roads.groupBy("metric", "node").agg(F.count(F.lit(1)).alias("_deg")).where(F.col("_deg") > hot_degree)
    hot = cut_lineage(degree.select("metric", "node", F.ceil(F.col("_deg") / hot_degree).cast("int").alias("_salts")))
    if hot.isEmpty():
        return lambda frontier: frontier.join(roads, ["metric", "node"]).select(*columns)
    one = F.lit(1)
    salted = cut_lineage(roads.join(hot, ["metric", "node"], "left").withColumn(
        "_salt", F.pmod(F.xxhash64("dst"), F.coalesce("_salts", one)).cast("int")).drop("_salts"))

    def extend(frontier: DataFrame) -> DataFrame:
        spread = frontier.join(hot, ["metric", "node"], "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", one) - 1)))
        return spread.join(salted, ["metric", "node", "_salt"]).select(*columns)

    return extend


def exposure(routes: DataFrame, edges: DataFrame, risk: DataFrame) -> DataFrame:
    """Largest risk met by each route: at its nodes and beside its edges."""
    legs = routes.select("metric", "src", "dst", "path", F.posexplode("path").alias("pos", "node"))
    legs = legs.select("metric", "src", "dst", "node", F.get("path", F.col("pos") + 1).alias("nxt"))
    beside = edges.select(F.col("src").alias("node"), F.col("dst").alias("nxt"), "worst")
    met = legs.join(risk, "node", "left").join(beside, ["node", "nxt"], "left")
    return met.groupBy("metric", "src", "dst").agg(F.max(F.greatest("risk", "worst")).alias("max_risk"))


def compare_routes(routes: DataFrame, exposed: DataFrame, base: str = "length", aware: str = "risk",
                   digits: int = 2) -> DataFrame:
    """Both routes of each request side by side, the zones avoided and the deltas."""
    r = routes.join(exposed, ["metric", "src", "dst"])
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = r.groupBy("src", "dst").agg(*[
        pick(m, c).alias(f"{n}_{c}") for m, n in ((base, "base"), (aware, "aware")) for c in ("cost", "path", "max_risk")])
    wide = wide.withColumn("avoided", F.array_except("base_path", "aware_path"))
    return wide.withColumns(S.route_deltas("base_cost", "aware_cost", "base_max_risk", "aware_max_risk", digits))


def unreachable(requests: DataFrame, nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests without an answer: unknown endpoints first, then those with no path."""
    known = nodes.select("node")
    ends = requests.select("src", "dst", F.explode(F.array("src", "dst")).alias("node"))
    unknown = ends.join(known, "node", "left_anti").select("src", "dst").distinct().withColumn("reason", F.lit("unknown endpoint"))
    rest = requests.join(unknown, ["src", "dst"], "left_anti").join(routes.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return unknown.unionByName(rest.select("src", "dst", F.lit("no route").alias("reason")))


def waypoints(routes: DataFrame, centres: DataFrame) -> DataFrame:
    """Map points of each path with midpoints between consecutive centres (an array per path)."""
    pts = routes.select("metric", "src", "dst", F.posexplode("path").alias("pos", "node")).join(centres, "node")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct("lat", "lng").alias("p"))))
    per = pts.groupBy("metric", "src", "dst").agg(F.transform(ordered, lambda x: x["p"]).alias("points"))
    return per.withColumn("points", S.with_midpoints("points"))
