"""Evaluation metrics as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgauge.operators.joins import dense_index, lookup, measured


def error_sums(pairs: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """The sums that MAE, RMSE and R2 need; they add up over groups."""
    e = F.col(y) - F.col(p)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"),
        F.sum(e * e).alias("see"), F.sum(F.abs(e)).alias("sae"))


def metrics_from_sums(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.col("n")
    total = F.col("syy") - F.col("sy") * F.col("sy") / n
    return sums.select(*by, "n", (F.col("sae") / n).alias("mae"), F.sqrt(F.col("see") / n).alias("rmse"),
                       F.when(total > 0, 1.0 - F.col("see") / total).alias("r2"))


def regression_metrics(pairs: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return metrics_from_sums(error_sums(pairs, by, y, p), by)


def mixed_draw(a: Column, b: Column, seed: int) -> Column:
    """A repeatable draw in [0, 2^31-1) by quadratic steps modulo a prime.

    Integer arithmetic only, so any SQL engine repeats it exactly.
    """
    prime = F.lit(2147483647)
    h = F.pmod(a * 1000003 + b * 10007 + seed, prime)
    for step in (12345, 67891, 23456):
        h = F.pmod(h * h + step + a * 31 + b, prime)
    return h


def mixed_draw_sql(a: str, b: str, seed: int) -> str:
    h = f"(({a}) * 1000003 + ({b}) * 10007 + {seed}) % 2147483647"
    for step in (12345, 67891, 23456):
        h = f"(({h}) * ({h}) + {step} + ({a}) * 31 + ({b})) % 2147483647"
    return h


def cluster_bootstrap(pairs: DataFrame, world: str, replicates: int = 2000, seed: int = 7, buckets: int = 64,
                      level: float = 0.95) -> DataFrame:
    """Confidence interval of R2 from resampling whole worlds.

    Rows collapse to sums per world first; a replicate then draws as many worlds as there are.
    Replicates without variance are skipped. The final percentile sees one value per replicate.
    """
    spark = pairs.sparkSession
    sums = error_sums(pairs, [world])
    numbered = measured(dense_index(sums, F.pmod(F.col(world).cast("long"), F.lit(buckets)), [world]))
    n_worlds = numbered.count()
    draws = spark.range(replicates * n_worlds).select(
        F.floor(F.col("id") / n_worlds).alias("rep"), F.pmod("id", F.lit(n_worlds)).alias("slot"))
    draws = draws.select("rep", F.pmod(mixed_draw(F.col("rep"), F.col("slot"), seed), F.lit(n_worlds)).alias("idx"))
    picked = draws.join(numbered, "idx").groupBy("rep").agg(
        *[F.sum(c).alias(c) for c in ("n", "sy", "syy", "see", "sae")])
    r2 = metrics_from_sums(picked, ["rep"]).where(F.col("r2").isNotNull())
    tail = (1.0 - level) / 2.0
    return r2.agg(F.count(F.lit(1)).alias("n_replicates"), F.avg("r2").alias("mean_r2"),
                  F.percentile("r2", F.lit(tail)).alias("r2_low"), F.percentile("r2", F.lit(1.0 - tail)).alias("r2_high"))


def confusion(pairs: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return pairs.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))


def class_report(pairs: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1 and support per class; an undefined ratio counts as 0.

    Each confusion cell is read once as truth and once as prediction, so no label grid is built.
    """
    cells = confusion(pairs, y, p)
    votes = cells.select("n", F.inline(F.array(
        F.struct(F.col(y).alias("label"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred")),
        F.struct(F.col(p).alias("label"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred")))),
        (F.col(y) == F.col(p)).cast("int").alias("hit"))
    s = votes.groupBy("label").agg(
        F.sum(F.col("n") * F.col("is_true") * F.col("hit")).alias("tp"), F.sum(F.col("n") * F.col("is_true")).alias("support"),
        F.sum(F.col("n") * F.col("is_pred")).alias("predicted"))
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2.0 * precision * recall / (precision + recall)).otherwise(0.0)
    return s.select("label", "support", "predicted", "tp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def class_summary(report: DataFrame, critical: str) -> DataFrame:
    """Macro F1, balanced accuracy over classes that occur, accuracy and one class's recall."""
    return report.agg(
        F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.coalesce(F.max(F.when(F.col("label") == critical, F.col("recall"))), F.lit(0.0)).alias("critical_recall"))


def reliability(pairs: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Mean prediction and observed rate per probability bin; empty bins do not appear."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return pairs.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"),
        F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("sum_sq"))


def calibration_summary(reliability_table: DataFrame) -> DataFrame:
    n = F.sum("n")
    return reliability_table.agg(
        n.alias("n"), (F.sum("sum_sq") / n).alias("brier"),
        (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))) / n).alias("ece"))


def best_variant(results: DataFrame, by: str, metric: str, variant: str) -> DataFrame:
    """The variant with the largest metric per target, the first by name on ties."""
    best = F.min_by(F.struct(variant, metric), F.struct(F.negate(F.col(metric)), F.col(variant)))
    return results.groupBy(by).agg(best.alias("b")).select(by, f"b.{variant}", f"b.{metric}")


def majority_class(train: DataFrame, label: str) -> DataFrame:
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), label).limit(1)


def world_folds(rows: DataFrame, world: str, k: int = 5, buckets: int = 64) -> DataFrame:
    """Whole worlds to folds 0..k-1 of (almost) equal numbers of worlds."""
    worlds = dense_index(rows.select(world).distinct(), F.pmod(F.col(world).cast("long"), F.lit(buckets)), [world])
    return lookup(rows, worlds.select(world, F.pmod("idx", F.lit(k)).cast("int").alias("fold")), world, "inner")
