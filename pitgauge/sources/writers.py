"""Sinks: the partitioned panel, its manifest, and scenario trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Panel partitioned by world; rows are spread by (world, zone) so one world is not one task."""
    panel.repartition("seed", "zone_id").write.mode(mode).partitionBy("seed").parquet(path)


def write_grid(grid: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A long (day, lat, lon, value) grid in folders of years, cells in order, so that a cell's rows are few row groups of each year."""
    rows = grid.select("day", "lat", "lon", "value", F.year("day").alias("year"))
    order = ["year", "lat", "lon", "day"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("year").parquet(path)


def manifest(panel: DataFrame) -> DataFrame:
    """Rows, zones, day span and mean score per world."""
    return panel.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("zone_id").alias("n_zones"),
        F.min("day_idx").alias("first_day"), F.max("day_idx").alias("last_day"))


def write_manifest(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    manifest(panel).select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_export(panel: DataFrame, path: str, subset: list[int] | None = None, mode: str = "overwrite") -> None:
    """All worlds, or a subset of them as a filter, into one table."""
    rows = panel if subset is None else panel.where(F.col("seed").isin(subset))
    write_panel(rows, path, mode)


def write_trajectories(runs: DataFrame, scenarios: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scenario rows by scenario, with the scenario definitions and row counts beside them."""
    runs.repartition("scenario_id", "seed", "zone_id").write.mode(mode).partitionBy("scenario_id").parquet(f"{path}/rows")
    counts = runs.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n_rows"))
    scenarios.join(counts, "scenario_id", "left").write.mode(mode).json(f"{path}/meta")
