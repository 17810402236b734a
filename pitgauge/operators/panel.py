"""Daily totals, gap filling and the panel contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitgauge.schemas import ML_PROJECTION


def fill_daily_gaps(daily: DataFrame, keys: Sequence[str], day: str, start: Column, end: Column,
                    defaults: Mapping[str, object]) -> DataFrame:
    """One row per series and day between ``start`` and ``end``; absent days take ``defaults``.

    Both bounds are parameters of the result: rows outside them (or without a day) are left out before
    anything is filled, so a day comes once and never before ``start``. A series without a row inside has none.

    Each row also emits the empty days up to its successor, so no calendar grid is joined:
    one exchange by series, and the result stays partitioned by series for later windows. The
    exchange keeps the session's partition count: it is small, and merging its partitions would
    run the windows that follow (and scenarios exploded after it) in few tasks.
    """
    daily = daily.where((F.col(day) >= start) & (F.col(day) <= end))
    daily = daily.repartition(int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    w = Window.partitionBy(*keys).orderBy(day)
    spans = daily.select(
        "*",
        F.when(F.lag(day).over(w).isNull(), start).otherwise(F.col(day)).alias("_lo"),
        F.coalesce(F.date_sub(F.lead(day).over(w), 1), end).alias("_hi"),
    ).withColumnRenamed(day, "_day")
    filled = spans.select("*", F.explode(F.sequence("_lo", "_hi")).alias(day))
    is_row = F.col(day) == F.col("_day")
    return filled.select(
        *keys, day,
        *[F.when(is_row, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in defaults.items()])


def project_contract(panel: DataFrame, mapping: Mapping[str, str] = ML_PROJECTION,
                     extra: Sequence[str] = ()) -> DataFrame:
    """Internal names to the published feature names (a projection, not a copy)."""
    return panel.select(*[F.col(src).alias(dst) for dst, src in mapping.items()], *extra)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reorder to ``schema``, cast, and add absent columns as typed nulls."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def column_differences(df: DataFrame, schema: T.StructType) -> tuple[list[str], list[str]]:
    """(missing, unexpected) column names against the contract."""
    expected, have = [f.name for f in schema.fields], df.columns
    return [c for c in expected if c not in have], [c for c in have if c not in expected]


def column_presence(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(column_name, status, n_values): present, missing or unexpected columns, counted in one aggregate."""
    have = df.columns
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(have)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit("present" if c in expected else "unexpected").alias("status"), F.col(f"n{i}").alias("n_values")) for i, c in enumerate(have)]
    rows += [F.struct(F.lit(c).alias("column_name"), F.lit("missing").alias("status"), F.lit(0).cast("long").alias("n_values")) for c in expected if c not in have]
    return counts.select(F.inline(F.array(*rows)))


def split_by_group(df: DataFrame, group: str, splits: Mapping[str, Sequence[int]]) -> DataFrame:
    """Label whole groups (worlds) as train / validation / test by membership."""
    out = None
    for name, members in splits.items():
        cond = F.col(group).isin(list(members))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return df.withColumn("split", out)


def split_by_day(df: DataFrame, train_to: int, validation_to: int, day: str = "day_idx") -> DataFrame:
    """Chronological split on the day index (both bounds belong to the earlier part)."""
    return df.withColumn("split", F.when(F.col(day) <= train_to, "train")
                         .when(F.col(day) <= validation_to, "validation").otherwise("test"))


def split_by_row(df: DataFrame, draw: Column, test_percent: int) -> DataFrame:
    """Row-level split that ignores worlds: kept only to measure its leakage."""
    return df.withColumn("split", F.when(F.pmod(draw, F.lit(100)) < test_percent, "test").otherwise("train"))
