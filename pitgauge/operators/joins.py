"""Joins against dimensions, nearest-zone search and distributed row numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgauge.functions.scoring import planar_distance
from pitgauge.session import cut_lineage


def measured(df: DataFrame) -> DataFrame:
    """Persist a derived dimension so its true size is known when a join is planned.

    Catalyst takes the size of a cached relation from its blocks: below
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and the large side is not
    shuffled, above it the join is a sort-merge join that AQE splits on skewed keys.
    Lost blocks are recomputed from lineage.
    """
    df = df.persist()
    df.count()
    return df


def lookup(rows: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join with a derived dimension, broadcast only when its measured size allows."""
    return rows.join(measured(dim), on, how)


def missing_keys(rows: DataFrame, dim: DataFrame, key: str, reason: str) -> DataFrame:
    """Keys without a partner, for checks that must come out empty."""
    return (rows.select(key).distinct().join(dim.select(key).distinct(), key, "left_anti")
            .withColumn("reason", F.lit(reason)))


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def _cell_size(height: float, width: float, cells: float) -> float:
    """Side of the squares of which about ``cells`` (more than 1) cover a rectangle, edges included: it may be as thin as a line."""
    both = height + width
    return (both + (both * both + 4 * (cells - 1) * height * width) ** 0.5) / (2 * (cells - 1))


def nearest_zone(points: DataFrame, zones: DataFrame, cell_rows: int = 50_000, cell_zones: int = 16) -> DataFrame:
    """``points`` with the closest zone's ``zone_id`` and ``dist`` (ties go to the smaller zone id), one row per row of ``points``.

    ``points`` has (lat, lng) and any other columns, ``zones`` (zone_id, lat, lng). Rounds of equi-joins on grid cells
    whose size grows fourfold each round, from about ``cell_zones`` zones a cell; with no more zones than that, the first cell is the whole extent and the first round the last. A point is settled once its best candidate is no farther than one cell,
    because every zone within that distance lies in the 3x3 neighbourhood that was searched, and the last cell size covers
    the whole extent. Zones are copied to their neighbour cells; a cell of more than ``cell_rows`` waiting points is dealt to as
    many salts as its count asks for. Of zones at one position only the smallest id can win, so the others are dropped first. The copied zones
    are merge-joined: the planner takes their size from the zone table, from before the copying, and would broadcast them through the driver. The least distance is found first and its smallest zone id in a second join: two plain minima are
    kept by hash, the minimum of a pair would sort all pairs of point and zone.
    Points without a finite position and points in an empty zone table keep a null zone and distance;
    repeated rows are repeated; zones without a finite position are never near.
    """
    names = [c for c in points.columns if c not in ("zone_id", "dist")]
    own = cut_lineage(points.select(*names).withColumn("_row", F.monotonically_increasing_id()))
    zones = zones.select("zone_id", F.col("lat").alias("_zlat"), F.col("lng").alias("_zlng")).where(F.col("zone_id").isNotNull() & _finite("_zlat") & _finite("_zlng"))
    zones = cut_lineage(zones.groupBy("_zlat", "_zlng").agg(F.min("zone_id").alias("zone_id")))
    places = own.where(_finite("lat") & _finite("lng")).select("_row", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    zb = zones.agg(F.min("_zlat"), F.max("_zlat"), F.min("_zlng"), F.max("_zlng"), F.count(F.lit(1))).first()
    pb = places.agg(F.min("_lat"), F.max("_lat"), F.min("_lng"), F.max("_lng")).first()
    if zb[4] == 0 or pb[0] is None:
        return own.select(*names, F.lit(None).cast(zones.schema["zone_id"].dataType).alias("zone_id"), F.lit(None).cast("double").alias("dist"))
    extent = max(max(zb[1], pb[1]) - min(zb[0], pb[0]), max(zb[3], pb[3]) - min(zb[2], pb[2]), 1e-12)
    size = extent if zb[4] <= cell_zones else max(_cell_size(zb[1] - zb[0], zb[3] - zb[2], zb[4] / cell_zones), extent * 1e-6)
    offsets = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    pending, settled = places, None
    while True:
        last = size >= extent
        cell = {"_cy": F.floor(F.col("_lat") / size), "_cx": F.floor(F.col("_lng") / size)}
        shares = pending.withColumns(cell).groupBy("_cy", "_cx").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("_salts"))
        cells = (
            zones.withColumns({"_gy": F.floor(F.col("_zlat") / size), "_gx": F.floor(F.col("_zlng") / size)})
            .withColumn("_dy", F.explode(offsets)).withColumn("_dx", F.explode(offsets))
            .select("zone_id", "_zlat", "_zlng", (F.col("_gy") + F.col("_dy")).alias("_cy"), (F.col("_gx") + F.col("_dx")).alias("_cx"))
            .join(shares.hint("merge"), ["_cy", "_cx"]).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts"))
        dist = planar_distance(F.col("_lat"), F.col("_lng"), F.col("_zlat"), F.col("_zlng"))
        met = lambda rows, how: (rows.withColumns(cell).join(shares.hint("merge"), ["_cy", "_cx"])
                                 .withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts"))).drop("_salts").join(cells.hint("merge"), ["_cy", "_cx", "_salt"], how))
        best = cut_lineage(met(pending, "left").groupBy("_row", "_lat", "_lng").agg(F.min(dist).alias("dist")))
        near = F.coalesce((F.col("dist") <= size) | (F.lit(last) & F.col("dist").isNotNull()), F.lit(False))
        done = met(best.where(near), "inner").where(dist == F.col("dist")).groupBy("_row", "dist").agg(F.min("zone_id").alias("zone_id"))
        settled = done if settled is None else settled.unionByName(done)
        pending = best.where(~near).select("_row", "_lat", "_lng")
        if last or pending.isEmpty():
            return own.join(settled, "_row", "left").select(*names, "zone_id", "dist")
        size *= 4


def dense_index(df: DataFrame, bucket: Column, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Gap-free numbers 0..n-1 in (bucket, order) sequence without a global sort.

    ``bucket`` must take few values that spread the rows evenly (a hash modulo a count). Rows
    are ranked inside their bucket and shifted by the rows of the buckets before it; only the
    bucket totals meet in one task.
    """
    keyed = df.withColumn("_bucket", bucket)
    totals = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return (lookup(ranked, shifts, "_bucket", "inner")
            .withColumn(name, F.col("_rn") - 1 + F.col("_shift")).drop("_bucket", "_rn", "_shift"))
