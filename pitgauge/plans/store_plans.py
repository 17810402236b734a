"""Queries that write a table, read it back through the reader made for it, and answer from what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgauge.operators import scenario as SC
from pitgauge.plans.registry import R, query, rounded
from pitgauge.plans.scenario_plans import _KEYS3, _RUN, scenario_runs, scenario_table
from pitgauge.plans.sql import DENSE, ORDERS_DAILY, PANEL
from pitgauge.session import scratch_path, shared_dir
from pitgauge.sources import adapters as A
from pitgauge.sources import layout as L
from pitgauge.sources import readers as RD
from pitgauge.sources import writers as WR


@query("station_reader", f"""WITH {ORDERS_DAILY} SELECT CAST(year(day) AS INTEGER) AS year, count(*) AS n_days, max(day) AS last_day, {R('sum(value)', alias='total')} FROM od GROUP BY 1""")
def station_reader(spark, folder):
    """The daily series exported as text and read with its declared schema, by year."""
    path = scratch_path(spark, "station")
    A.orders_daily(spark, folder).select("station_id", "day", "value").write.csv(path)
    years = RD.daily_series(spark, path, "csv").groupBy(F.year("day").alias("year"))
    return rounded(years.agg(F.count(F.lit(1)).alias("n_days"), F.max("day").alias("last_day"), F.sum("value").alias("total")), ["year", "n_days", "last_day"], ["total"])


@query("grid_reader", """SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS value, count(*) AS n FROM lineitem
 WHERE l_suppkey % 10 = 7 AND l_partkey % 10 = 2 AND l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1996-01-01' GROUP BY 1""")
def grid_reader(spark, folder):
    """One cell of a grid kept in folders of years: other years are not opened."""
    path = scratch_path(spark, "grid")
    WR.write_grid(RD.table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 10).cast("double").alias("lat"), (F.col("l_partkey") % 10).cast("double").alias("lon"), F.col("l_quantity").alias("value")), path)
    return RD.grid_cell(RD.read_grid(spark, path), 7.0, 2.0, 1994, 1995).groupBy("day").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))


BOX = (40.0, 2.0, 160.0, 8.0)


@query("grid_box", f"""SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, sum(l_quantity) AS total FROM lineitem
 WHERE l_partkey BETWEEN {BOX[0]} AND {BOX[2]} AND l_suppkey BETWEEN {BOX[1]} AND {BOX[3]} GROUP BY 1""")
def grid_box(spark, folder):
    """A box of a grid written along a space-filling curve, read by ranges of the curve."""
    cells = RD.table(spark, folder, "lineitem").select(F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"), "l_shipdate", "l_quantity")
    path = scratch_path(spark, "curve")
    L.write_curve(cells, path, "x", "y", L.curve_of(cells, "x", "y"))
    return L.read_box(spark, path, *BOX).groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@query("manifest_reader", f"WITH {DENSE} SELECT seed, count(*) AS n_rows, count(DISTINCT zone_id) AS n_zones, min(day_idx) AS first_day, max(day_idx) AS last_day FROM dense GROUP BY seed")
def manifest_reader(spark, folder):
    """The panel's manifest as it stands in its text file, one line a world."""
    path = scratch_path(spark, "manifest")
    WR.write_manifest(A.events_dense(spark, folder), path)
    fields = "seed bigint, n_rows bigint, n_zones bigint, first_day int, last_day int"
    return spark.read.text(path).select(F.from_json("value", fields).alias("m")).select("m.*")


@query("trajectory_sink", _RUN + f""", n AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS3} ORDER BY day_idx) - 1 AS pos, count(*) OVER (PARTITION BY {_KEYS3}) AS n FROM runs)
SELECT scenario_id, count(*) AS n_rows, count(*) AS listed_rows, {R('min(fos)', alias='least_fos')} FROM n WHERE pos % greatest(CAST(ceil(n / 8e0) AS BIGINT), 1) = 0 OR pos = n - 1 GROUP BY 1""")
def trajectory_sink(spark, folder):
    """Trajectories written by scenario, read back beside the row counts of their metadata."""
    path = scratch_path(spark, "trajectories")
    WR.write_trajectories(SC.trajectory(scenario_runs(spark, folder), 8), scenario_table(spark), path)
    rows = spark.read.parquet(f"{path}/rows").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("fos").alias("least_fos"))
    meta = spark.read.schema("scenario_id string, n_rows bigint").json(f"{path}/meta").select("scenario_id", F.col("n_rows").alias("listed_rows"))
    return rounded(rows.join(meta, "scenario_id", "full"), ["scenario_id", "n_rows", "listed_rows"], ["least_fos"])


@query("built_once", f"WITH {PANEL} SELECT seed, count(*) AS n_rows, {R('max(score)', alias='top_score')} FROM panel GROUP BY seed")
def built_once(spark, folder):
    """The scored panel, built for the present events unless an earlier run has done so."""
    panel = RD.read_or_build(spark, f"{shared_dir(spark)}/built/panel", lambda: A.events_panel(spark, folder), plan=["events_panel", 1], inputs=[f"{folder}/events.parquet"])
    return rounded(panel.groupBy("seed").agg(F.count(F.lit(1)).alias("n_rows"), F.max("score").alias("top_score")), ["seed", "n_rows"], ["top_score"])
