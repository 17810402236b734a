"""The benchmark tables bound to the panel, series, raster and graph shapes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgauge.operators.panel import fill_daily_gaps
from pitgauge.operators.windows import _so_far, series_window, with_long_memory
from pitgauge.schemas import ENUMS, literal_table, materials, zones
from pitgauge.sources.readers import table

PANEL_START = dt.date(2024, 1, 1)


def events_daily(ev: DataFrame) -> DataFrame:
    """Sparse user-day totals of the event stream (map-side combined before the exchange)."""
    kind, v = F.col("event_type"), F.col("value")
    return (
        ev.select((F.col("user_id") % 5).alias("seed"), F.col("user_id").alias("zone_id"),
                  F.to_date("ts").alias("day"), kind, v)
        .groupBy("seed", "zone_id", "day")
        .agg(
            F.coalesce(F.sum(F.when(kind.isin("view", "click"), v)), F.lit(0.0)).alias("rainfall_mm"),
            F.count_if(kind == "purchase").alias("n_blast"),
            F.coalesce(F.max(F.when(kind == "purchase", v)) / 5.0, F.lit(0.0)).alias("ppv"),
            F.count_if(kind == "signup").alias("n_inspect"),
            F.count_if(kind == "error").alias("err"),
            F.coalesce(F.sum(F.when(kind == "error", v)) / 100.0, F.lit(0.0)).alias("growth"),
        )
    )


def events_dense(spark: SparkSession, folder: str) -> DataFrame:
    """Every user on every day from the panel start to the last day seen."""
    ev = table(spark, folder, "events")
    last_day = ev.agg(F.to_date(F.max("ts"))).scalar()
    dense = fill_daily_gaps(
        events_daily(ev), ["seed", "zone_id"], "day", F.lit(PANEL_START), last_day,
        {"rainfall_mm": 0.0, "n_blast": 0, "ppv": 0.0, "n_inspect": 0, "err": 0, "growth": 0.0})
    return dense.select(
        "seed", "zone_id", F.date_diff("day", F.lit(PANEL_START)).alias("day_idx"), "rainfall_mm",
        (F.col("rainfall_mm") > 0).alias("wet_day"), (F.col("n_blast") > 0).alias("blast_occurs"), "ppv",
        (F.col("n_inspect") > 0).alias("inspected"), F.col("err").cast("long").alias("err"), "growth")


def events_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The dense panel with groundwater memory, crack density and the demonstration score."""
    ws = series_window()
    wetted = with_long_memory(events_dense(spark, folder), F.col("rainfall_mm") / 10.0, "groundwater_proxy")
    state = wetted.withColumn("crack_density", F.least(F.lit(2.5), 0.05 + 0.1 * F.sum("err").over(_so_far(ws))))
    return state.withColumn("score", demo_score("groundwater_proxy", "crack_density", "ppv"))


#: Site binding of the benchmark: each zone's material, and the point within its ranges at which the chain is run.
SITE = [("ZONE_A", 0, "lateritic_soil", 40.0, 300.0, 24.0, 20.0), ("ZONE_B", 1, "clayey_sandstone", 80.0, 90.0, 32.0, 21.5),
        ("ZONE_C", 2, "lignite", 200.0, 60.0, 20.0, 13.5), ("ZONE_D", 3, "clay", 600.0, 0.0, 20.0, 19.0)]


def site_zones(spark: SparkSession) -> DataFrame:
    """The four site zones with geometry from the zone dimension and weakness and clay from the material dimension."""
    site = literal_table(spark, SITE, "zone_id string, slot int, material_class string, thrust double, cohesion double, phi double, gamma double")
    z = zones(spark).select("zone_id", F.col("zone_kind").alias("kind"), F.col("bench_height_m").alias("bench_h"), F.col("bench_face_angle_deg").alias("slope"), "blastable")
    m = materials(spark).select("material_class", "weakness", "clay")
    return site.join(z, "zone_id").join(m, "material_class").withColumnRenamed("zone_id", "zone_code")


def with_site_attributes(panel: DataFrame) -> DataFrame:
    """Static slope attributes by a join with the site zones, to which the panel's zones are assigned round-robin."""
    site = site_zones(panel.sparkSession).select(
        F.col("slot").alias("_slot"), "zone_code", "kind", "bench_h", "slope", "weakness", "clay", "thrust", "cohesion", "phi", "gamma",
        F.col("bench_h").alias("height"), F.col("slope").alias("theta"), F.col("slope").alias("face"), "blastable")
    sited = panel.withColumn("_slot", (F.col("zone_id") % 4).cast("int")).join(site, "_slot").drop("_slot")
    return sited.withColumn("cap", F.when(F.col("kind") == "floor", 1.0).otherwise(0.4 * F.col("bench_h")))


def site_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Drivers only (rain in mm, blasting) with site attributes: the input of the causal chain."""
    dense = events_dense(spark, folder).withColumn("rainfall_mm", F.col("rainfall_mm") / 10.0)
    return with_site_attributes(dense.select("seed", "zone_id", "day_idx", "rainfall_mm", "blast_occurs", "ppv"))


def demo_score(proxy, density, ppv):
    raw = 0.6 * F.col(proxy) + 15.0 * F.col(density) + 0.6 * F.col(ppv)
    return F.least(F.lit(100.0), raw)


def station_daily(orders: DataFrame) -> DataFrame:
    """Urgent filled order value per day, one station, every day of the span.

    The aggregate leaves one row per calendar day, which bounds every window over it.
    """
    span = orders.agg(F.struct(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))).scalar()
    return _filled(orders, span["first"], span["last"])


def _filled(orders: DataFrame, first, last, more: DataFrame | None = None) -> DataFrame:
    wet = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    rows = orders.select(F.to_date("o_orderdate").alias("day"), F.when(wet, F.col("o_totalprice")).alias("v"))
    per_day = (
        (rows if more is None else rows.union(more)).groupBy("day").agg((F.coalesce(F.sum("v"), F.lit(0.0)) / 10000.0).alias("value"))
        .select(F.lit("S1").alias("station_id"), "day", "value"))
    return fill_daily_gaps(per_day, ["station_id"], "day", first, last, {"value": 0.0})


def orders_slice(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """The daily series between two days: the source is cut before its gaps are filled, so the scan reads only these days.

    The ends of the whole series come from a scan of the date column alone; days outside them aren't made up.
    """
    orders = table(spark, folder, "orders")
    ends = orders.agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")).first()
    lo, hi = F.greatest(F.lit(ends["a"]), F.lit(first).cast("date")), F.least(F.lit(ends["b"]), F.lit(last).cast("date"))
    kind = orders.schema["o_orderdate"].dataType
    cut = orders.where((F.col("o_orderdate") >= F.lit(first).cast(kind)) & (F.col("o_orderdate") < F.date_add(F.lit(last).cast("date"), 1).cast(kind)))
    start = spark.range(1).where(lo <= hi).select(lo.alias("day"), F.lit(None).cast("double").alias("v"))  # so that a slice without orders is filled too
    return _filled(cut, lo, hi, start)


def orders_daily(spark: SparkSession, folder: str) -> DataFrame:
    return station_daily(table(spark, folder, "orders"))


def lineitem_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity per day for each flag/status series, from its own first day to its last."""
    per_day = (
        table(spark, folder, "lineitem")
        .select(F.concat("l_returnflag", "l_linestatus").alias("series"), F.to_date("l_shipdate").alias("day"), "l_quantity")
        .groupBy("series", "day").agg(F.sum("l_quantity").alias("value")))
    dense = fill_daily_gaps(per_day, ["series"], "day", F.col("day"), F.col("day"), {"value": 0.0})
    return dense.select("series", "day", F.date_diff("day", F.lit(dt.date(1995, 1, 1))).alias("day_idx"), "value")


def slope_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """One slope per part with the attributes of the stability chain."""
    key, size = F.col("p_partkey"), F.col("p_size")
    severity = F.element_at(F.array(*[F.lit(s) for s in ENUMS["crack_severity"]]), (size % 5 + 1).cast("int"))
    return table(spark, folder, "part").select(
        key.alias("slope_id"),
        (29 + key % 130).cast("double").alias("cohesion"), (25 + size % 15).cast("double").alias("phi"),
        (18 + key % 6).cast("double").alias("gamma"), (6 + size % 20).cast("double").alias("height"),
        (45 + key % 30).cast("double").alias("theta"), (45 + key % 30).cast("double").alias("face"),
        (F.col("p_retailprice") % 250.0).alias("proxy"), ((size % 25).cast("double") / 10.0).alias("density"),
        severity.alias("severity"), (key % 2 == 0).alias("filled"),
        F.when(key % 17 == 0, "floor").otherwise("bench").alias("zone_kind"),
        (490 + size).cast("double").alias("pore_kpa"))


def raster_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as an elevation matrix: vector id is the row, position the column."""
    return table(spark, folder, "embeddings").select(
        F.lit("T1").alias("tile"), F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"),
    ).select("tile", "row", F.col("col").cast("long").alias("col"), (F.col("v").cast("double") * 100.0).alias("elev"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("point_id"), "label", e[0].cast("double").alias("lat"), e[1].cast("double").alias("lng"))


def label_centres(spark: SparkSession, folder: str) -> DataFrame:
    return (points(spark, folder).groupBy(F.col("label").cast("long").alias("zone_id"))
            .agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng")))


def price_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Regression pairs: price against a quantity-based guess, in ten worlds."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("world"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))


def quality_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Probability pairs: document quality against a length-based guess."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars").cast("double")
    return (table(spark, folder, "labels").select("doc_id", "quality").join(docs, "doc_id")
            .select("doc_id", F.col("quality").alias("y"), (n / (n + 500.0)).alias("p")))


def class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Class pairs: flag/status code against the code shifted by the line number."""
    names = F.array(*[F.lit(c) for c in ("FA", "FN", "FR", "OA", "ON", "OR")])
    y = F.concat("l_linestatus", "l_returnflag")
    idx = F.array_position(names, y)
    shifted = F.element_at(names, (F.pmod(idx - 1 + F.col("l_linenumber") % 3, F.lit(6)) + 1).cast("int"))
    return table(spark, folder, "lineitem").select(y.alias("y"), shifted.alias("p"))
