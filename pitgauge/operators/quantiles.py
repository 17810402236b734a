"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitgauge.session import cut_lineage


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    task_rows: int = 2_000_000, splits: int = 32) -> DataFrame:
    """Linear-interpolation quantiles as rows (by..., prob, quantile), exact at any size.

    The built-in ``percentile`` gathers all distinct values of a group in one task; elsewhere it
    is used for calendar-bounded groups only. Here each wanted rank is an interval (lo, hi] of
    values with the number of rows before it. While an interval holds more than ``task_rows``
    rows it is narrowed: a mergeable sketch proposes ``splits`` cut points, the rows between
    cuts are counted (both combined map-side), and the piece with the rank remains. Then only
    the rows of the remaining intervals are shuffled, counted by value and ranked. Pieces of a
    single repeated value are answered at once, so a value held by a third of all rows is no
    obstacle. The interval table has two rows per group and probability. Nulls are left out; NaN is the
    largest value, as in ``percentile``. The narrow projection is written once, so what computes ``df`` runs once.
    """
    by = list(by)
    rows = cut_lineage(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")))
    spots = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"), fn(F.lit(float(p)) * (F.col("_size") - 1).cast("double")).alias("rank"))
        for p in probs for side, fn in (("a", F.floor), ("b", F.ceil))])
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where("_size > 0")
    targets = totals.select("*", F.col("_size").alias("_n"), F.inline(spots)).withColumns({
        "lo": F.lit(float("-inf")), "hi": F.lit(float("nan")), "before": F.lit(0).cast("long"), "answer": F.lit(None).cast("double")})
    targets = cut_lineage(targets)
    while not targets.where((F.col("_size") > task_rows) & F.col("answer").isNull()).isEmpty():
        targets = cut_lineage(_narrow(rows, targets, by, splits))
    open_ = targets.where(F.col("answer").isNull())
    ranked = _inside(rows, open_, by).groupBy(*by, "lo", "before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    so_far = Window.partitionBy(*by, "lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_end", F.col("before") + F.sum("_c").over(so_far))
    ranked = ranked.select(*by, "lo", "_v", "_end", (F.col("_end") - F.col("_c")).alias("_begin"))
    small = open_.select(*[F.col(c).alias(f"_t_{c}") for c in by], F.col("lo").alias("_t_lo"), "prob", "side", "rank", "_n")
    same = F.col("lo").eqNullSafe(F.col("_t_lo"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    found = ranked.join(small, same & (F.col("_begin") <= F.col("rank")) & (F.col("rank") < F.col("_end"))).select(
        *by, "prob", "side", "_n", F.col("_v").alias("answer"))
    done = targets.where(F.col("answer").isNotNull()).select(*by, "prob", "side", "_n", "answer")
    pairs = found.unionByName(done).groupBy(*by, "prob").agg(
        F.max("_n").alias("_n"), F.max(F.when(F.col("side") == "a", F.col("answer"))).alias("_a"),
        F.max(F.when(F.col("side") == "b", F.col("answer"))).alias("_b"))
    exact = F.col("prob") * (F.col("_n") - 1).cast("double")
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (exact - F.floor(exact))
    return pairs.select(*by, "prob", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("quantile"))


def _inside(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Rows that lie in an interval of their group, once per interval."""
    spans = targets.select(*[F.col(c).alias(f"_t_{c}") for c in by], "lo", "hi", "before").distinct()
    hit = (F.col("_v") > F.col("lo")) & (F.col("_v") <= F.col("hi")) | (F.col("lo") == float("-inf")) & (F.col("_v") == float("-inf"))
    for c in by:
        hit = hit & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return rows.join(spans, hit).select(*by, "_v", "lo", "hi", "before")


def _narrow(rows: DataFrame, targets: DataFrame, by: list[str], splits: int) -> DataFrame:
    """Each open interval cut into pieces, and every target moved to the piece with its rank."""
    keys = [*by, "lo", "hi"]
    inside = _inside(rows, targets.where(F.col("answer").isNull()), by)
    marks = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    cuts = inside.groupBy(*keys).agg(F.percentile_approx("_v", marks, F.lit(splits * 20)).alias("_cuts"))
    cuts = cut_lineage(cuts).withColumnsRenamed({c: f"_c_{c}" for c in keys})
    match = None
    for c in keys:
        m = F.col(c).eqNullSafe(F.col(f"_c_{c}"))
        match = m if match is None else match & m
    # a cut value is a piece of its own, so a heavy value is split off in one step
    slot = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
    placed = inside.join(cuts, match).withColumn("_slot", slot)
    pieces = placed.groupBy(*keys, "_slot").agg(
        F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.max("before").alias("before"))
    w = Window.partitionBy(*keys).orderBy("_slot")
    pieces = pieces.select(
        *[F.col(c).alias(f"_p_{c}") for c in keys], "_k", "_min", "_max",
        F.coalesce(F.lag("_max").over(w), F.col("lo")).alias("_new_lo"),
        (F.col("before") + F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")).alias("_new_before"))
    own = None
    for c in keys:
        m = F.col(c).eqNullSafe(F.col(f"_p_{c}"))
        own = m if own is None else own & m
    own = own & (F.col("_new_before") <= F.col("rank")) & (F.col("rank") < F.col("_new_before") + F.col("_k"))
    moved = targets.where(F.col("answer").isNull()).join(pieces, own).select(
        *by, F.col("_k").alias("_size"), "_n", "prob", "side", "rank", F.col("_new_lo").alias("lo"), F.col("_max").alias("hi"),
        F.col("_new_before").alias("before"), F.when(F.col("_min") == F.col("_max"), F.col("_min")).alias("answer"))
    return moved.unionByName(targets.where(F.col("answer").isNotNull()))


def quantile_columns(quantiles: DataFrame, by: Sequence[str], names: dict[float, str]) -> DataFrame:
    """Quantile rows as one row per group."""
    return quantiles.groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(n) for p, n in names.items()])
