"""Unions, differences and equality of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with both counts; empty means exactly equal.

    One aggregate over the union answers both directions and combines repeated rows map-side.
    """
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counts = both.groupBy(*cols).agg(F.sum("_a").alias("n_left"), F.sum("_b").alias("n_right"))
    return counts.where(F.col("n_left") != F.col("n_right"))


def equality_report(a: DataFrame, b: DataFrame) -> DataFrame:
    diff = multiset_difference(a, b)
    return diff.agg(F.count(F.lit(1)).alias("n_different"), (F.count(F.lit(1)) == 0).alias("is_equal"))


def tolerance_report(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float) -> DataFrame:
    """Largest absolute difference per column over a key join; unmatched keys are counted."""
    right = b.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in cols], F.lit(True).alias("_in_b"))
    left = a.select(*keys, *cols, F.lit(True).alias("_in_a"))
    both = left.join(right, list(keys), "full_outer")
    gap = F.array_max(F.array(*[F.abs(F.col(c) - F.col(f"_r_{c}")) for c in cols]))
    return both.agg(
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("n_unmatched"),
        F.max(gap).alias("max_gap"), F.count_if(gap > tol).alias("n_beyond"))


def digest(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., digest): rows, sum and exclusive or of the hashes of the other columns; the order of rows does not matter, repeated rows count."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns) if c not in by])
    parts = [F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"), F.bit_xor(h).alias("mixed")]
    return df.groupBy(*by).agg(*parts).select(*by, F.struct("n", "total", "mixed").alias("digest"))


def differing_groups(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """The groups in which two tables differ: compared by digests, so only those groups need to be looked at row by row."""
    x = digest(a, by).withColumnRenamed("digest", "_x")
    y = digest(b, by).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("digest").alias("_y"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    both = x.join(y, same, "full").where(~F.col("_x").eqNullSafe(F.col("_y")))
    return both.select(*[F.when(F.col("_x").isNotNull(), F.col(c)).otherwise(F.col(f"_g{i}")).alias(c) for i, c in enumerate(by)])
