"""Large forests whose trees are each grown in one task, from rows reduced to a few bytes, and never come to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgauge.operators.setops import digest
from pitgauge.operators.split_forest import SplitClassForest, SplitForest
from pitgauge.session import cut_lineage, shared_dir
from pitgauge.sources.publish import exists, fingerprint, publish

#: Rows whose bins fit a task beside what growing a tree takes; more are fitted by the library over all tasks.
TASK_ROWS = 4_000_000
#: Nodes whose histograms a task holds at a time, cells that a task scores at a time, and quantiles of which the borders of bins are taken.
_NODES, _CELLS, _QUANTILES = 4_096, 500_000, 511
_TREE = "tree int, feature binary, bin binary, left binary, value binary"


def borders(ready: DataFrame, bins: int) -> list[list[float]]:
    """Per feature at most ``bins`` - 1 values that part its rows; spread over its different values, so that one common value does not take the others' places."""
    x = ready.select(vector_to_array("features").alias("x"))
    n = x.agg(F.max(F.size("x"))).first()[0] or 0
    at = [k / (_QUANTILES + 1) for k in range(_QUANTILES + 2)]
    found = x.agg(*[F.percentile_approx(F.get("x", i), at, 4_000).alias(f"q{i}") for i in range(n)]).first() if n else []
    out = []
    for values in found:
        values = np.unique([v for v in values if np.isfinite(v)])[:-1]  # nothing lies beyond the last
        out.append(values[np.unique(np.linspace(0, len(values) - 1, bins - 1).round().astype(int))].tolist() if len(values) else [])
    return out


def binned(rows: DataFrame, edges: Sequence[Sequence[float]], cell: str = "cell") -> DataFrame:
    """Rows with ``cell``: a byte for each value of ``features``, the number of borders below it (all of them for a value that is none)."""
    at = [np.asarray(e) for e in edges]
    return rows.withColumn(cell, _cells(at)(vector_to_array("features")))


def _cells(at: Sequence[np.ndarray]):
    @F.arrow_udf("binary")
    def cells(x: pa.Array) -> pa.Array:
        flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        out = np.empty((len(x), len(at)), np.uint8)
        for i, e in enumerate(at):
            out[:, i] = np.searchsorted(e, flat[:, i])
        return pa.array([r.tobytes() for r in out], pa.binary())

    return cells


def _matrix(cells: pa.ChunkedArray | pa.Array) -> np.ndarray:
    data = b"".join(cells.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(cells), -1)


class Spec:
    """What a tree needs to know of its forest; ``classes`` is 0 for a mean."""

    def __init__(self, depth: int, least: int, bins: int, classes: int, features: int):
        self.depth, self.least, self.bins, self.classes = depth, least, bins, classes
        self.some = max(1, ceil(sqrt(features)) if classes else ceil(features / 3))  # features that a node may choose from


class Rows:
    """The different rows of a fit in their order: ``x`` has their bins, ``times`` says how often each came, ``of`` is the number of its bins among the different ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, times: np.ndarray):
        order = np.lexsort((weight, y, *x.T[::-1]))
        self.x, self.y, self.weight, self.times = x[order], y[order], weight[order], times[order]
        new = np.r_[True, np.any(self.x[1:] != self.x[:-1], axis=1)]
        self.of, self.cells = np.cumsum(new) - 1, self.x[new]

    def bag(self, spec: Spec, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """Bins, count, weight and class (or sum) of a bootstrap sample; for a mean, rows of the same bins are one."""
        count = rng.poisson(self.times).astype(float)
        count = count if count.any() else self.times.astype(float)
        mass = count * self.weight
        if spec.classes:
            kept = np.flatnonzero(count)
            return self.x[kept], count[kept], mass[kept], self.y[kept].astype(np.int64)
        n = len(self.cells)
        count, total, mass = np.bincount(self.of, count, n), np.bincount(self.of, mass * self.y, n), np.bincount(self.of, mass, n)
        kept = np.flatnonzero(count)
        return self.cells[kept], count[kept], mass[kept], total[kept]


def grow_tree(given: Rows, spec: Spec, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(feature or -1, bin, left child, value) of the nodes of one tree; the right child comes after the left one.

    A row's share of the bootstrap sample is a Poisson number with the mean of its ``times``. Nodes are split level by level at the bin of least
    variance or Gini impurity among a few random features of each node.
    """
    x, count, mass, y = given.bag(spec, rng)
    same, flat, f, k_stats = bool(np.all(given.weight == 1)), x.ravel(), x.shape[1], spec.classes or 1

    def sums(key: np.ndarray, n: int, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, weight and weighted classes (or the weighted sum) of each key."""
        rows = np.bincount(key, count[e], n)
        if not spec.classes:
            return rows, rows if same else np.bincount(key, mass[e], n), np.bincount(key, y[e], n)[:, None]
        stat = np.bincount(key * spec.classes + y[e], mass[e], n * spec.classes).reshape(n, spec.classes)
        return rows, stat.sum(1), stat

    def purity(heavy: np.ndarray, stat: np.ndarray) -> np.ndarray:
        square = stat[..., 0] * stat[..., 0] if k_stats == 1 else np.einsum("...i,...i", stat, stat)
        return square / np.maximum(heavy, 1e-300)

    def running(of_bins: np.ndarray, m: int) -> np.ndarray:
        return of_bins.reshape(m, spec.bins, *of_bins.shape[1:]).cumsum(1)[:, :-1]

    e, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    rows, heavy, stat = sums(node, 1, e)
    out, made = [], 1
    for level in range(spec.depth + 1):
        n = len(rows)
        value = np.divide(stat, heavy[:, None], out=np.zeros(stat.shape), where=heavy[:, None] > 0)
        feature, at, left = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, np.int32)
        out.append((feature, at, left, value))
        may = rows >= 2 * spec.least
        if spec.classes:
            may &= stat.max(1) < heavy
        if level == spec.depth or not may.any():
            break
        stays = may[node]
        e, node = e[stays], (np.cumsum(may) - 1)[node[stays]]
        open_, here = np.flatnonzero(may), purity(heavy[may], stat[may])
        if len(open_) > _NODES:
            order = np.argsort(node, kind="stable")
            e, node = e[order], node[order]
        split, children = np.zeros(len(open_), bool), []
        for low in range(0, len(open_), _NODES):
            high = min(low + _NODES, len(open_))
            part = slice(*np.searchsorted(node, (low, high))) if len(open_) > _NODES else slice(None)
            pe, pn, m = e[part], node[part] - low, high - low
            some = np.argsort(rng.random((m, f)), axis=1)[:, :spec.some]
            t_rows, t_heavy, t_stat = rows[open_[low:high]], heavy[open_[low:high]], stat[open_[low:high]]
            best, best_f, best_b = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64)
            l_rows, l_heavy, l_stat = np.zeros(m), np.zeros(m), np.zeros((m, k_stats))
            for j in range(some.shape[1]):
                key = pn * spec.bins + flat[pe * f + some[pn, j]]
                h = sums(key, m * spec.bins, pe)
                a, c = running(h[0], m), running(h[2], m)
                b = a if h[1] is h[0] else running(h[1], m)
                fits = (a >= spec.least) & (t_rows[:, None] - a >= spec.least)
                good = np.where(fits, purity(b, c) + purity(t_heavy[:, None] - b, t_stat[:, None] - c), -np.inf)
                b_at = good.argmax(1)
                i = np.arange(m)
                up = np.flatnonzero(good[i, b_at] > best)
                u = b_at[up]
                best[up], best_f[up], best_b[up] = good[up, u], some[up, j], u
                l_rows[up], l_heavy[up], l_stat[up] = a[up, u], b[up, u], c[up, u]
            won = best - here[low:high] > 1e-10 * np.maximum(here[low:high], 1e-300)
            split[low:high] = won
            feature[open_[low:high][won]], at[open_[low:high][won]] = best_f[won], best_b[won]
            both = [np.stack([v[won], t[won] - v[won]], 1) for v, t in ((l_rows, t_rows), (l_heavy, t_heavy), (l_stat, t_stat))]
            children.append([v.reshape(-1, *v.shape[2:]) for v in both])
        if not split.any():
            break
        left[open_[split]] = made + 2 * np.arange(np.count_nonzero(split))
        made += 2 * np.count_nonzero(split)
        goes = split[node]
        e, node = e[goes], node[goes]
        right = flat[e * f + feature[open_[node]]] > at[open_[node]]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        rows, heavy, stat = (np.concatenate(v) for v in zip(*children))
    return tuple(np.concatenate(v) for v in zip(*out))


def tree_values(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The value of the leaf that each row of bins comes to."""
    feature, at, left, value = tree
    flat, f = x.ravel(), x.shape[1]
    node, going = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(going):
        here = node[going]
        inner = feature[here] >= 0
        going, here = going[inner], here[inner]
        node[going] = left[here] + (flat[going * f + feature[here]] > at[here])
    return value[node]


def _grow(trees: Sequence[int], spec: Spec, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def grow(batches):
        given = pa.Table.from_batches(list(batches))
        if given.num_rows:
            x = _matrix(given["cell"])
            rows = Rows(x, *(given[c].to_numpy() for c in ("y", "weight", "times")))
            for t in trees:
                made = grow_tree(rows, spec, np.random.default_rng([seed, t]))
                columns = [pa.array([v], pa.binary()) for v in (a.tobytes() for a in made)]
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *columns], names=["tree", "feature", "bin", "left", "value"])

    return grow


def _score(classes: int) -> Callable[[pa.Table], pa.Table]:
    """The sum of the trees' values for each cell of one part and one block."""

    def score(rows: pa.Table) -> pa.Table:
        is_cell = np.array([t is None for t in rows["tree"].to_pylist()], bool)
        cells = rows.filter(pa.array(is_cell))["cell"]
        total = np.zeros((len(cells), classes or 1))
        if len(cells):
            x = _matrix(cells)
            for r in rows.filter(pa.array(~is_cell)).sort_by("tree").select(["feature", "bin", "left", "value"]).to_batches(max_chunksize=1):
                parts = [np.frombuffer(r[c][0].as_py(), kind) for c, kind in (("feature", np.int16), ("bin", np.uint8), ("left", np.int32), ("value", float))]
                total += tree_values(x, (*parts[:3], parts[3].reshape(len(parts[0]), -1)))
        return pa.table({"cell": cells, "total": pa.array(list(total), pa.list_(pa.float64()))})

    return score


class TaskForestModel:
    """The mean of all trees, or the class with the most of their summed votes; the trees stay in their files."""

    def __init__(self, prep: PipelineModel, edges: Sequence[Sequence[float]], places: Sequence[str], trees: int, classes: int):
        self.prep, self.edges, self.places, self.trees, self.classes = prep, edges, list(places), trees, classes

    @property
    def stages(self) -> list:
        return self.prep.stages

    def tree_rows(self, spark) -> DataFrame:
        every = [spark.read.schema(_TREE).parquet(place).withColumn("part", F.lit(k)) for k, place in enumerate(self.places)]
        out = every[0]
        for t in every[1:]:
            out = out.unionByName(t)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """Each different cell is scored once, in blocks of cells and parts of the forest, and its score joined to its rows."""
        spark = rows.sparkSession
        ready = cut_lineage(binned(self.prep.transform(rows), self.edges, "_cell").select(*rows.columns, *[c for c in ("_label",) if self.classes], "_cell"))
        cells = cut_lineage(ready.select(F.col("_cell").alias("cell")).distinct())
        blocks = max(1, ceil(cells.count() / _CELLS))
        part, block = F.explode(F.sequence(F.lit(0), F.lit(len(self.places) - 1))), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        asked = cells.select("cell", F.pmod(F.xxhash64("cell"), F.lit(blocks)).cast("int").alias("block"), part.alias("part"))
        work = asked.unionByName(self.tree_rows(spark).select("*", block.alias("block")), allowMissingColumns=True)
        scored = work.groupBy("part", "block").applyInArrow(_score(self.classes), "cell binary, total array<double>")
        each = [F.sum(F.get("total", i)).alias(f"v{i}") for i in range(self.classes or 1)]
        votes = cut_lineage(scored.groupBy(F.col("cell").alias("_cell")).agg(*each))
        if self.classes:
            all_votes = F.array(*[f"v{i}" for i in range(self.classes)])
            prediction = (F.array_position(all_votes, F.array_max(all_votes)) - 1).cast("double")
        else:
            prediction = F.col("v0") / self.trees
        return ready.join(votes.select("_cell", prediction.alias("prediction")), "_cell").drop("_cell")


class TaskForest(SplitForest):
    """``SplitForest`` for rows that fit a task (``TASK_ROWS``): the same sizes, bins, bootstrap and choice of features, trees grown by ``grow_tree``.

    Each part of the forest is one task over the rows' bins and is published when done, as are the borders of the bins. More rows are fitted as
    ``SplitForest`` does it, spread over all tasks.
    """

    def spec(self, estimator, features: int, prep: PipelineModel) -> Spec:
        return Spec(estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getMaxBins(), 0, features)

    def row_values(self) -> list:
        return [F.col(self.label).cast("double").alias("y"), F.lit(1.0).alias("weight")]

    def fit(self, rows: DataFrame):
        spark = rows.sparkSession
        rows = rows.select(*self.numeric, *self.categorical, *self.given_columns())
        state = digest(rows).select("digest.*").first()
        if not 0 < state["n"] <= TASK_ROWS:
            return super().fit(rows)
        name = fingerprint("task", self.label, self.numeric, self.categorical, self.depth, self.seed, self.params, [str(v) for v in state])
        base = f"{(self.folder or shared_dir(spark)).rstrip('/')}/forests/{name}"
        places = [f"{base}/{k}-of-{n}-trees" for k, n in enumerate(self.sizes)]
        prep = Pipeline(stages=self.stages()).fit(rows)
        missing = [k for k, place in enumerate(places) if not exists(spark, place)]
        ready = prep.transform(rows).select("features", *self.fitted_columns())
        if not exists(spark, f"{base}/borders"):
            ready = cut_lineage(ready)
            found = borders(ready, self.estimator(0).getMaxBins())
            publish(spark, f"{base}/borders", lambda aside: spark.createDataFrame(list(enumerate(found)), "i int, at array<double>").coalesce(1).write.parquet(aside))
        edges = [r["at"] for r in spark.read.schema("i int, at array<double>").parquet(f"{base}/borders").orderBy("i").collect()]
        spec = self.spec(self.estimator(0), len(edges), prep)
        if missing:
            table = cut_lineage(binned(ready, edges).select("cell", *self.row_values()).groupBy("cell", "y", "weight").agg(F.count(F.lit(1)).alias("times")))

        @inheritable_thread_target(spark)
        def part(k: int):
            est = self.estimator(k)
            first = sum(self.sizes[:k])
            made = table.coalesce(1).mapInArrow(_grow(range(first, first + self.sizes[k]), spec, est.getSeed()), _TREE)
            publish(spark, places[k], lambda aside: made.write.parquet(aside))

        with ThreadPoolExecutor(self.parallelism or max(2, spark.sparkContext.defaultParallelism)) as pool:
            list(pool.map(part, missing))
        return TaskForestModel(prep, edges, places, sum(self.sizes), spec.classes)


class TaskClassForest(TaskForest, SplitClassForest):
    """``SplitClassForest`` with trees that are each grown in one task."""

    def spec(self, estimator, features: int, prep: PipelineModel) -> Spec:
        return Spec(estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getMaxBins(), len(prep.stages[0].labels) + 1, features)

    def row_values(self) -> list:
        return [F.col("_label").alias("y"), F.col(self.weight).cast("double").alias("weight")]
