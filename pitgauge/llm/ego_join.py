"""Cosine similarity join of embeddings by epsilon grid order.

Unit vectors are turned onto their principal axes. On the leading axes they fall into cells as wide as the distance that the
threshold allows, and are sorted by cell. The sorted sequence is cut into intervals; two intervals whose boxes are further apart are
never brought together, and those that meet are halved again and again, each half being skipped as soon as it is provably distant.
Only counts and a spanning forest leave a pair of intervals, never its links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgauge.llm.common import col
from pitgauge.llm.graph import connected_components, forest
from pitgauge.session import cut_lineage

AXES = 4
INTERVAL = 2048
LEAF = 128
SLACK = 1e-9


def signed(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v, hi, lo): digests are null for vectors that link with nothing."""
    rows = df.select(col(key).cast("long").alias("id"), col(label).cast("string").alias("label"), col(vector).cast("array<double>").alias("v"))

    def run(batches):
        for b in batches:
            hi, lo = [], []
            for lab, v in zip(b.column(1).to_pylist(), b.column(2)):
                x = None if lab is None or not v.is_valid else v.values
                x = None if x is None or x.null_count or not len(x) else x.to_numpy(zero_copy_only=False) + 0.0
                if x is None or not np.isfinite(x).all() or not x.any():
                    hi.append(None), lo.append(None)
                    continue
                d = np.frombuffer(hashlib.blake2b(lab.encode() + b"\0" + x.tobytes(), digest_size=16).digest(), dtype=np.int64)
                hi.append(int(d[0])), lo.append(int(d[1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["id", "label", "v", "hi", "lo"])

    return rows.mapInArrow(run, "id long, label string, v array<double>, hi long, lo long")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(reps: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the second moments by falling eigenvalue: d x d sums from each task, added up by Spark."""

    def moments(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = [v for v in b.column(0).to_pylist() if len(v) == d]
            if x:
                u = unit(np.array(x))
                total += u.T @ u
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = reps.select("v").mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((d, d))
    for r in sums:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    return np.linalg.eigh(m)[1][:, ::-1].copy()


def intervals(reps: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """The sorted sequence as rows of up to ``INTERVAL`` vectors of one label and length, with boxes on the principal axes."""
    d = len(axes)
    lead = min(AXES, d)

    def place(batches):
        for b in batches:
            vectors = b.column(3).to_pylist()
            dims = [len(v) for v in vectors]
            cells = np.zeros((len(vectors), lead), dtype=np.int64)  # other lengths have no axes and share a cell
            own = [i for i, n in enumerate(dims) if n == d]
            if own:
                cells[own] = np.floor((unit(np.array([vectors[i] for i in own])) @ axes)[:, :lead] / eps)
            cells = cells.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], names=["id", "m", "label", "v", "dims", "cells"])

    def cut(batches):
        part, number, held = TaskContext.get().partitionId(), 0, []

        def out(rows):
            x = np.array([r["v"] for r in rows])
            y = unit(x) @ axes if x.shape[1] == d else unit(x)
            return {"block": [(part << 32) + number], "label": [rows[0]["label"]], "dims": [rows[0]["dims"]], "lo": [y.min(axis=0).tolist()], "hi": [y.max(axis=0).tolist()],
                    "ids": [[r["id"] for r in rows]], "ms": [[r["m"] for r in rows]], "x": [x.tobytes()]}

        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) == INTERVAL or (held[0]["label"], held[0]["dims"]) != (r["label"], r["dims"])):
                    yield pa.RecordBatch.from_pydict(out(held), schema=arrow)
                    number, held = number + 1, []
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pydict(out(held), schema=arrow)

    arrow = pa.schema([("block", pa.int64()), ("label", pa.string()), ("dims", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
                       ("ids", pa.list_(pa.int64())), ("ms", pa.list_(pa.int64())), ("x", pa.binary())])
    placed = reps.select("id", "m", "label", "v").mapInArrow(place, "id long, m long, label string, v array<double>, dims long, cells array<long>")
    order = ["label", "dims", *[F.col("cells")[i] for i in range(lead)], "id"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(cut, "block long, label string, dims long, lo array<double>, hi array<double>, ids array<long>, ms array<long>, x binary")


def near_intervals(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: intervals of one label whose boxes are at most ``eps`` apart.

    They meet in a cell of the first axis: one side in the cells it spans, the other also in those next to them.
    """
    box = blocks.select("block", "label", "dims", "lo", "hi", F.floor(F.col("lo")[0] / eps).alias("c"), F.floor(F.col("hi")[0] / eps).alias("e"))
    a = box.select(F.col("block").alias("a"), "label", "dims", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence("c", "e")).alias("cell"))
    b = box.select(F.col("block").alias("b"), "label", "dims", F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(F.col("c") - 1, F.col("e") + 1)).alias("cell"))
    gap = F.zip_with(F.zip_with("alo", "bhi", lambda x, y: x - y), F.zip_with("blo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return a.join(b, ["label", "dims", "cell"]).where("a <= b").where(apart <= F.lit((eps + SLACK) ** 2)).select("a", "b").distinct()


def pair_links(xa: np.ndarray, xb: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) whose cosine reaches the threshold; with ``same``, each pair once and none with itself."""
    ua, ub = unit(xa), unit(xb)
    ya, yb = (ua @ axes, ub @ axes) if axes is not None and len(axes) == xa.shape[1] else (ua, ub)
    limit = (math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK) ** 2
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(i0, i1, j0, j1):
        if same and j1 - 1 <= i0:
            return
        alo, ahi, blo, bhi = ya[i0:i1].min(axis=0), ya[i0:i1].max(axis=0), yb[j0:j1].min(axis=0), yb[j0:j1].max(axis=0)
        gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
        if (gap * gap).sum() > limit:
            return
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            cos = ua[i0:i1] @ ub[j0:j1].T
            i, j = np.nonzero(cos >= threshold - SLACK)
            edge = np.flatnonzero(cos[i, j] < threshold + SLACK)
            if len(edge):  # by the formula itself where rounding could decide
                a, b = xa[i0 + i[edge]], xb[j0 + j[edge]]
                exact = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                keep = np.ones(len(i), bool)
                keep[edge] = exact >= threshold
                i, j = i[keep], j[keep]
            i, j = i + i0, j + j0
            if same:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
            return
        im, jm = (i0 + i1) // 2, (j0 + j1) // 2
        for p, q in ((i0, im), (im, i1)) if i1 - i0 > LEAF else ((i0, i1),):
            for r, s in ((j0, jm), (jm, j1)) if j1 - j0 > LEAF else ((j0, j1),):
                meet(p, q, r, s)

    meet(0, len(xa), 0, len(xb))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def epsilon_join(df: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``df``: its id, ``n_links``, ``component_id``, ``kept``; vectors of one label link at a cosine of ``threshold`` or more.

    Null, empty and zero vectors, vectors with null or non-finite components and rows without a label have no links and are their own
    component. Equal vectors are joined once and count as often as they come; a row is never its own link. Vectors of different
    length don't link. Other columns are ignored; an empty table gives an empty result.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) or SLACK
    rows = cut_lineage(signed(df, key, vector, label))
    valid = rows.where("hi is not null")
    reps = cut_lineage(valid.groupBy("hi", "lo").agg(F.min(F.struct("id", "label", "v")).alias("r"), F.count(F.lit(1)).alias("m"))
                       .select("hi", "lo", "r.id", "m", "r.label", "r.v"))
    d = reps.agg(F.max(F.size("v"))).first()[0]
    if d is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    axes = principal_axes(reps, d)
    blocks = cut_lineage(intervals(reps, axes, eps))
    pairs = near_intervals(blocks, eps).withColumn("pair", F.struct("a", "b"))
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(blocks.select("block", "ids", "ms", "x", "dims"), "block")

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        a, b = rows[0], rows[-1]
        same = a["block"] == b["block"]
        xa, xb = (np.frombuffer(r["x"], dtype=np.float64).reshape(-1, r["dims"]) for r in (a, b))
        i, j = pair_links(xa, xb, axes, threshold, same)
        na = len(xa)
        ids = np.array(a["ids"] if same else a["ids"] + b["ids"], dtype=np.int64)
        ms = np.array(a["ms"] if same else a["ms"] + b["ms"], dtype=np.int64)
        if not same:
            j = j + na
        count = np.bincount(i, weights=ms[j], minlength=len(ids)) + np.bincount(j, weights=ms[i], minlength=len(ids))
        hit = np.flatnonzero(count)
        top = forest(i, j, len(ids))
        return pa.table({"id": ids[hit], "links": count[hit].astype(np.int64), "near": ids[top[hit]]})

    found = cut_lineage(sides.groupBy("pair").applyInArrow(join, "id long, links long, near long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "id")
    done = reps.join(links, "id", "left").join(parts, "id", "left").select("hi", "lo", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "hi", "lo").join(done, ["hi", "lo"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
