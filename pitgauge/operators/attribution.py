"""Additive attribution of tree models: exact path-dependent Shapley terms.

Of each leaf, the features on its path have a share: the part of the training rows that their splits let through, and for a given row whether it
passes them. With t as the chance that a feature is known, a leaf's value is weighted by the product over its features of (share + t (passes - share)),
a polynomial in t. A feature's term is the leaf's value times (passes - share) times the integral over 0..1 of the product of the others: averaging over
t averages over all orders in which features become known. Gauss-Legendre sums of half as many points as features integrate that polynomial exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitgauge.session import scratch_path


@dataclass(frozen=True)
class Leaf:
    """A leaf's value (times its tree's weight) and, for each feature on its path, the open interval (lo, hi] that it lets through and the share of rows."""

    value: float
    features: tuple[int, ...]
    lo: tuple[float, ...]
    hi: tuple[float, ...]
    share: tuple[float, ...]


def saved_nodes(model, path: str | None = None) -> DataFrame:
    """The node table of a fitted pyspark.ml tree ensemble: one row per node with its tree, children, split, prediction and training rows."""
    spark = SparkSession.getActiveSession()
    path = path or scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    node = spark.read.parquet(f"{path}/data")
    n = "nodeData"
    return node.select(F.col("treeID").alias("tree"), *[F.col(f"{n}.{c}").alias(c) for c in ("id", "prediction", "leftChild", "rightChild", "rawCount")],
                       F.col(f"{n}.split.featureIndex").alias("feature"), F.col(f"{n}.split.leftCategoriesOrThreshold").alias("cut"), F.col(f"{n}.split.numCategories").alias("categories"))


def leaf_paths(nodes: Sequence, weights: Sequence[float]) -> list[Leaf]:
    """The leaves of all trees from their node rows: as many rows as the fitted model has nodes. Splits on more than two categories are not supported."""
    by = {(r["tree"], r["id"]): r for r in nodes}
    out = []

    def walk(tree: int, i: int, path: dict[int, tuple[float, float, float]]) -> None:
        r = by[tree, i]
        if r["leftChild"] < 0:
            f = sorted(path)
            out.append(Leaf(r["prediction"] * weights[tree], tuple(f), *[tuple(path[k][j] for k in f) for j in range(3)]))
            return
        if r["categories"] not in (-1, 2):
            raise ValueError("attribution needs numeric or two-valued splits")
        feature, cut, low, high = r["feature"], float(r["cut"][0]), r["leftChild"], r["rightChild"]
        if r["categories"] == 2:  # a slot of 0 and 1: the category listed goes left
            low, high, cut = (high, low, 0.5) if cut else (low, high, 0.5)
        lo, hi, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, a, b in ((low, lo, min(hi, cut)), (high, max(lo, cut), hi)):
            part = by[tree, child]["rawCount"] / r["rawCount"] if r["rawCount"] else 0.5
            walk(tree, child, {**path, feature: (a, b, share * part)})

    for tree in sorted({t for t, _ in by}):
        walk(tree, 0, {})
    return out


def ensemble_leaves(model) -> list[Leaf]:
    """Leaves of a fitted forest (trees averaged) or boosted ensemble (trees weighted)."""
    weights = list(model.treeWeights)
    scale = 1.0 if type(model).__name__.startswith("GBT") else sum(weights)
    return leaf_paths(saved_nodes(model).collect(), [w / scale for w in weights])


def expected(leaves: Sequence[Leaf]) -> float:
    """The prediction with no feature known: leaves by their shares of the training rows."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))


#: Leaves with at most this many features on their path get a table of their terms, one row for each set of features that a row passes.
TABLE_FEATURES = 10


def _terms(passes: np.ndarray, leaf: Leaf) -> np.ndarray:
    """A leaf's terms for rows given by which of its features they pass (row, feature)."""
    m = len(leaf.features)
    t, w = np.polynomial.legendre.leggauss((m + 1) // 2)
    t, w = (t + 1) / 2, w / 2
    gain = passes - np.array(leaf.share)
    factor = np.array(leaf.share)[None, :, None] + gain[:, :, None] * t[None, None, :]  # row, feature, point; never 0 at an inner point but for a share of 0
    before = np.cumprod(factor, axis=1)
    after = np.cumprod(factor[:, ::-1], axis=1)[:, ::-1]
    others = np.ones_like(factor)
    others[:, 1:] *= before[:, :-1]
    others[:, :-1] *= after[:, 1:]
    return leaf.value * gain * (others @ w)


def leaf_tables(leaves: Sequence[Leaf]) -> list[np.ndarray | None]:
    """(feature, code) terms of each leaf, where bit j of the code says that its feature j passes; none for leaves with too many features."""
    out: list[np.ndarray | None] = []
    for leaf in leaves:
        m = len(leaf.features)
        some = 0 < m <= TABLE_FEATURES and leaf.value
        out.append(np.ascontiguousarray(_terms((np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float), leaf).T) if some else None)
    return out


def shapley_terms(x: np.ndarray, leaves: Sequence[Leaf], tables: Sequence[np.ndarray | None] | None = None) -> np.ndarray:
    """Terms of each row and feature; with :func:`expected` they sum to the prediction.

    A row's terms at a leaf depend only on which of the leaf's features it passes, so they are looked up in the leaf's table (:func:`leaf_tables`,
    made once for many calls); only leaves without one are worked out row by row.
    """
    tables = leaf_tables(leaves) if tables is None else tables
    cols, out = np.ascontiguousarray(x.T), np.zeros((x.shape[1], x.shape[0]))
    for leaf, table in zip(leaves, tables):
        if not leaf.features or not leaf.value:
            continue
        passes = [(cols[f] > lo) & (cols[f] <= hi) for f, lo, hi in zip(leaf.features, leaf.lo, leaf.hi)]
        if table is None:
            terms = _terms(np.array(passes).T.astype(float), leaf).T
        else:
            code = passes[0].astype(np.intp)
            for j, p in enumerate(passes[1:], 1):
                code += p.astype(np.intp) << j
            terms = table.take(code, axis=1)
        for f, term in zip(leaf.features, terms):
            out[f] += term
    return np.ascontiguousarray(out.T)


def tree_contributions(model: PipelineModel, rows: DataFrame, names: Sequence[str], top: int | None = None) -> DataFrame:
    """``rows`` with ``prediction``, ``base`` and ``contributions``: (feature, term) by falling size, all of them or the ``top`` ones.

    ``names`` are the slots of the pipeline's feature vector. Base and all terms sum to the prediction. The leaves of the last stage go to the tasks
    with the function: their number is bounded by the model's trees and depth. Null and missing numbers fail every split to the left, as in the model.
    """
    leaves, n = ensemble_leaves(model.stages[-1]), len(names)
    base = expected(leaves)
    scored = model.transform(rows).select(*rows.columns, "prediction", vector_to_array("features").alias("_x"))
    term = T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("term", T.DoubleType())]))
    schema = T.StructType([*[scored.schema[c] for c in (*rows.columns, "prediction")], T.StructField("base", T.DoubleType()), T.StructField("contributions", term)])
    arrow, width = to_arrow_schema(schema), len(rows.columns) + 1
    listed = np.array(names)

    def run(batches):
        tables = leaf_tables(leaves)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                k = part.num_rows
                x = part.column(width).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(k, n)
                x = np.where(np.isnan(x), np.inf, x)
                terms = shapley_terms(x, leaves, tables)
                order = np.argsort(-np.abs(terms), axis=1, kind="stable")[:, :top]
                flat = pa.StructArray.from_arrays([pa.array(listed[order].ravel()), pa.array(np.take_along_axis(terms, order, axis=1).ravel())], fields=list(arrow.field(width + 1).type.value_type))
                ends = pa.array(np.arange(k + 1, dtype=np.int32) * order.shape[1])
                arrays = [part.column(j).cast(arrow.field(j).type) for j in range(width)] + [pa.array(np.full(k, base)), pa.ListArray.from_arrays(ends, flat).cast(arrow.field(width + 1).type)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    plain = [F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate((*rows.columns, "prediction"))]
    return scored.select(*plain, "_x").mapInArrow(run, schema)
