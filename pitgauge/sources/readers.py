"""Readers: station series, grids, rasters, corpora, live readings and cached tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitgauge.schemas import DAILY_SERIES_SCHEMA, GRID_SCHEMA, TABLE_SCHEMAS
from pitgauge.sources.publish import fingerprint, input_state, publish


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def daily_series(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema: T.StructType = DAILY_SERIES_SCHEMA, **options) -> DataFrame:
    """A daily station series with a declared schema; ordering is left to the windows."""
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def day_range(df: DataFrame, first_year: int, last_year: int, day: str = "day") -> DataFrame:
    """Year filter written as a day range, so it reaches the scan."""
    return df.where(F.col(day).between(F.lit(dt.date(first_year, 1, 1)), F.lit(dt.date(last_year, 12, 31))))


def date_slice(df: DataFrame, first: str, last: str, day: str = "day") -> DataFrame:
    return df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def grid_cell(grid: DataFrame, lat: float, lon: float, first_year: int, last_year: int) -> DataFrame:
    """The daily series of one grid cell; absent years simply contribute no rows, and years kept in folders of their own are not opened."""
    if "year" in grid.columns:
        grid = grid.where(F.col("year").between(first_year, last_year))
    picked = day_range(grid, first_year, last_year).where((F.col("lat") == lat) & (F.col("lon") == lon))
    return picked.select("day", "value")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Long grid table, one Parquet partition per year (``year`` prunes)."""
    return spark.read.schema(T.StructType([*GRID_SCHEMA.fields, T.StructField("year", T.IntegerType())])).parquet(path)


def raster_box(cells: DataFrame, west: float, south: float, east: float, north: float,
               lon: str = "lon", lat: str = "lat") -> DataFrame:
    return cells.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def integrity(df: DataFrame, value: str) -> DataFrame:
    """Row count, extremes and nulls of a freshly read column."""
    v = F.col(value)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
                  F.count_if(v.isNull()).alias("n_null"))


def constants_row(constants: DataFrame, keys: list[str]) -> DataFrame:
    """Key/value constants pivoted to one row."""
    return constants.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def corpus(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The exported panel; the world key is a partition column cast to long."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).withColumn("seed", F.col("seed").cast("long"))


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], plan=(), inputs: Sequence[str] = ()) -> DataFrame:
    """The table that ``build`` makes, built once below ``path`` for one ``plan`` and one state of the files of its ``inputs``.

    ``plan`` is any plain value that names what is built (parameters, a version). Another plan, or changed inputs, are built anew
    beside the earlier table, which stays for those who read it. Builders at the same time leave one whole table (``publish``).
    """
    place = f"{path.rstrip('/')}/{fingerprint(plan, input_state(spark, inputs))}"
    publish(spark, place, lambda aside: build().write.parquet(aside))
    return spark.read.parquet(place)


def latest_states(panel: DataFrame, seed: int | None = None, zone: str = "zone_id", day: str = "day_idx") -> DataFrame:
    """Latest row per zone (of one world when given), by aggregation rather than a sort."""
    rows = panel if seed is None else panel.where(F.col("seed") == seed)
    packed = F.max_by(F.struct(*[c for c in rows.columns if c != zone]), F.col(day))
    return rows.groupBy(zone).agg(packed.alias("_s")).select(zone, "_s.*")


def reading_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """Live readings as files appear; other sources need only another ``fmt`` and options."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A table of the folder as a stream of its part files; a table that is a single file is found by its name."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).isDirectory()
    options = {"maxFilesPerTrigger": str(files_per_trigger)} | ({} if whole else {"pathGlobFilter": f"{name}.parquet"})
    return reading_stream(spark, path if whole else folder, schema, **options)
