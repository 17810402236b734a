"""Terrain and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgauge.functions import scoring as S
from pitgauge.operators import raster as RS
from pitgauge.operators import routing as RT
from pitgauge.plans.registry import R, Rs, query, rounded
from pitgauge.plans.sql import CELLS
from pitgauge.session import cut_lineage
from pitgauge.sources import adapters as A
from pitgauge.sources import readers as RD

_SLOPE = f"""{CELLS}, gr AS (SELECT *, CASE WHEN lead(elev) OVER c IS NOT NULL AND lag(elev) OVER c IS NOT NULL THEN (lead(elev) OVER c - lag(elev) OVER c) / 2e0
  WHEN lead(elev) OVER c IS NOT NULL THEN lead(elev) OVER c - elev WHEN lag(elev) OVER c IS NOT NULL THEN elev - lag(elev) OVER c ELSE 0e0 END AS dx,
 CASE WHEN lead(elev) OVER r IS NOT NULL AND lag(elev) OVER r IS NOT NULL THEN (lead(elev) OVER r - lag(elev) OVER r) / 2e0
  WHEN lead(elev) OVER r IS NOT NULL THEN lead(elev) OVER r - elev WHEN lag(elev) OVER r IS NOT NULL THEN elev - lag(elev) OVER r ELSE 0e0 END AS dy
 FROM cells WINDOW c AS (PARTITION BY "row" ORDER BY col), r AS (PARTITION BY col ORDER BY "row")),
sl AS (SELECT "row", col, degrees(atan(sqrt((dx / 30.92e0) * (dx / 30.92e0) + (dy / 30.71e0) * (dy / 30.71e0)))) AS slope_deg FROM gr)"""


@query("raster_slope", f"""WITH {_SLOPE} SELECT "row", col, {R('slope_deg')} FROM sl""")
def raster_slope(spark, folder):
    return rounded(RS.slope(A.raster_cells(spark, folder), 30.92, 30.71, size=64), ["row", "col"], ["slope_deg"])


_RELIEF = f"""{CELLS}, h AS (SELECT *, max(elev) OVER c AS hi, min(elev) OVER c AS lo FROM cells WINDOW c AS (PARTITION BY "row" ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
rl AS (SELECT "row", col, max(hi) OVER r - min(lo) OVER r AS relief FROM h WINDOW r AS (PARTITION BY col ORDER BY "row" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@query("raster_relief", f"""WITH {_RELIEF} SELECT "row", col, {R('relief')} FROM rl""")
def raster_relief(spark, folder):
    return rounded(RS.relief(A.raster_cells(spark, folder), size=64), ["row", "col"], ["relief"])


@query("raster_summary", f"""WITH {CELLS} SELECT 'T1' AS tile, count(*) AS n_cells, {R('min(elev)', alias='min_value')}, {R('max(elev)', alias='max_value')}, {R('avg(elev)', alias='mean_value')}, {R('stddev_pop(elev)', alias='std_value')},
 {R('avg(CASE WHEN elev > 10 THEN 1e0 ELSE 0e0 END) * 100', alias='pct_over_0')}, {R('avg(CASE WHEN elev < 0 THEN 1e0 ELSE 0e0 END) * 100', alias='pct_below_0')}, {R('avg(CASE WHEN elev < -10 THEN 1e0 ELSE 0e0 END) * 100', alias='pct_below_1')},
 {R('count(*) FILTER (WHERE elev < 0) * 949.5532e0', 2, 'area_below_zero')}, {R('quantile_cont(elev, 0.05)', alias='p05')}, {R('quantile_cont(elev, 0.5)', alias='p50')}, {R('quantile_cont(elev, 0.95)', alias='p95')} FROM cells""")
def raster_summary(spark, folder):
    s = RS.summary(A.raster_cells(spark, folder), "elev", over=[10.0], below=[0.0, -10.0], cell_area=949.5532)
    s = s.withColumn("area_below_zero", F.round("area_below_zero", 2))
    return rounded(s, ["tile", "n_cells", "area_below_zero"], ["min_value", "max_value", "mean_value", "std_value", "pct_over_0", "pct_below_0", "pct_below_1", "p05", "p50", "p95"])


@query("slope_summary", f"""WITH {_SLOPE} SELECT count(*) AS n_cells, {R('min(slope_deg)', alias='min_value')}, {R('max(slope_deg)', alias='max_value')}, {R('avg(slope_deg)', alias='mean_value')}, {R('stddev_pop(slope_deg)', alias='std_value')},
 {R('avg(CASE WHEN slope_deg > 15 THEN 1e0 ELSE 0e0 END) * 100', alias='pct_over_0')}, {R('avg(CASE WHEN slope_deg > 30 THEN 1e0 ELSE 0e0 END) * 100', alias='pct_over_1')}, {R('quantile_cont(slope_deg, 0.5)', alias='p50')}, {R('quantile_cont(slope_deg, 0.95)', alias='p95')} FROM sl""")
def slope_summary(spark, folder):
    sl = RS.slope(A.raster_cells(spark, folder), 30.92, 30.71, size=64)
    s = RS.summary(sl, "slope_deg", over=[15.0, 30.0], probs=[0.5, 0.95])
    return rounded(s, ["n_cells"], ["min_value", "max_value", "mean_value", "std_value", "pct_over_0", "pct_over_1", "p50", "p95"])


@query("raster_window", f"""WITH {CELLS} SELECT "row", col, {R('elev')} FROM cells WHERE "row" BETWEEN 100 AND 199 AND col BETWEEN 8 AND 40""")
def raster_window(spark, folder):
    """Cells inside a bounding box."""
    return rounded(RD.raster_box(A.raster_cells(spark, folder), 8, 100, 40, 199, lon="col", lat="row"), ["row", "col"], ["elev"])


# ---------------------------------------------------------------- routing over the supplier road graph
STEPS = [1, 5, 25, 125, 625]
ALPHA = 0.01


def supplier_graph(spark, folder):
    """Suppliers as zones, roads to the key neighbours, risk as the share of returned lines.

    Requests go from the first supplier of each nation to all suppliers of that nation.
    """
    sup = RD.table(spark, folder, "supplier")
    nodes = sup.select(F.col("s_suppkey").alias("node"))
    i = F.col("s_suppkey")
    half = sup.select(i.alias("src"), F.explode(F.array(*[F.lit(s).cast("long") for s in STEPS])).alias("step")).withColumn("dst", F.col("src") + F.col("step"))
    roads = half.join(nodes.withColumnRenamed("node", "dst"), "dst").select(
        (F.col("src") * 10000 + F.col("step")).alias("road_id"), "src", "dst",
        (1 + (7 * F.col("src") + 13 * F.col("dst")) % 11).cast("double").alias("length"), F.lit(None).cast("array<bigint>").alias("adjacent"))
    li = RD.table(spark, folder, "lineitem")
    share = li.groupBy(F.col("l_suppkey").alias("node")).agg(F.round(100.0 * F.avg((F.col("l_returnflag") == "R").cast("double")), 2).alias("share"))
    risk = nodes.join(share, "node", "left").select("node", F.coalesce("share", F.lit(0.0)).alias("risk"))
    depots = sup.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("src"))
    requests = sup.join(depots, "s_nationkey").where("s_suppkey <> src").select("src", F.col("s_suppkey").alias("dst"))
    edges = cut_lineage(RT.with_worst_risk(RT.build_edges(nodes, roads), risk))
    return nodes, edges, risk, requests


def routes(edges, requests):
    return RT.cheapest_paths(edges, requests, {"length": F.col("length"), "risk": S.edge_cost("length", "worst", F.lit(ALPHA))})


_ROUNDS = 16


def _routes_sql() -> str:
    sql = f"""rk AS (SELECT s_suppkey AS node, coalesce(round(100 * avg(CASE WHEN l_returnflag = 'R' THEN 1e0 WHEN l_returnflag IS NOT NULL THEN 0e0 END), 2), 0e0) AS risk
  FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
ud AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, CAST(1 + (7 * a.s_suppkey + 13 * b.s_suppkey) % 11 AS DOUBLE) AS length FROM supplier a, (SELECT unnest({STEPS}) AS st) s, supplier b WHERE b.s_suppkey = a.s_suppkey + st),
ed AS (SELECT m.metric, x.src, x.dst, CASE WHEN m.metric = 'length' THEN x.length ELSE x.length * (1 + {ALPHA}e0 * greatest(ra.risk, rb.risk)) END AS w
  FROM (SELECT i AS src, j AS dst, length FROM ud UNION ALL SELECT j, i, length FROM ud) x JOIN rk ra ON ra.node = x.src JOIN rk rb ON rb.node = x.dst, (SELECT unnest(['length', 'risk']) AS metric) m),
rq AS (SELECT d.src, s.s_suppkey AS dst FROM supplier s JOIN (SELECT s_nationkey, min(s_suppkey) AS src FROM supplier GROUP BY 1) d USING (s_nationkey) WHERE s.s_suppkey <> d.src),
b0 AS (SELECT m.metric, src AS source, src AS node, {{'cost': 0e0, 'path': [src]}} AS s FROM (SELECT DISTINCT src FROM rq), (SELECT unnest(['length', 'risk']) AS metric) m)"""
    for k in range(1, _ROUNDS + 1):
        sql += f""",
b{k} AS MATERIALIZED (SELECT metric, source, node, min(s) AS s FROM (SELECT * FROM b{k - 1} UNION ALL
  SELECT b.metric, b.source, e.dst, {{'cost': b.s.cost + e.w, 'path': list_append(b.s.path, e.dst)}} FROM b{k - 1} b JOIN ed e ON e.metric = b.metric AND e.src = b.node WHERE NOT list_contains(b.s.path, e.dst)) GROUP BY 1, 2, 3)"""
    return sql + f""",
rt AS (SELECT metric, rq.src, rq.dst, b.s.cost AS cost, b.s.path AS path FROM rq JOIN b{_ROUNDS} b ON b.source = rq.src AND b.node = rq.dst),
ex AS (SELECT metric, src, dst, max(risk) AS max_risk FROM (SELECT metric, src, dst, unnest(path) AS node FROM rt) JOIN rk USING (node) GROUP BY 1, 2, 3),
wide AS (SELECT a.src, a.dst, a.cost AS base_cost, b.cost AS aware_cost, a.path AS base_path, b.path AS aware_path, ea.max_risk AS base_max_risk, eb.max_risk AS aware_max_risk
 FROM rt a JOIN rt b ON a.src = b.src AND a.dst = b.dst AND a.metric = 'length' AND b.metric = 'risk' JOIN ex ea ON ea.metric = 'length' AND ea.src = a.src AND ea.dst = a.dst
 JOIN ex eb ON eb.metric = 'risk' AND eb.src = a.src AND eb.dst = a.dst)"""


_RT = _routes_sql()


@query("route_compare", f"""WITH {_RT} SELECT src, dst, {Rs(['base_cost', 'aware_cost', 'base_max_risk', 'aware_max_risk'])}, array_to_string(base_path, '>') AS base_path, array_to_string(aware_path, '>') AS aware_path,
 array_to_string([x FOR x IN base_path IF NOT list_contains(aware_path, x)], ',') AS avoided, {R('aware_cost - base_cost', 6, 'distance_delta')}, {R('(aware_cost - base_cost) * 1.5', 5, 'time_delta_min')},
 CAST(CASE WHEN base_max_risk > 0 THEN floor((base_max_risk - aware_max_risk) / base_max_risk * 100 + 0.5) ELSE 0 END AS BIGINT) AS risk_reduction_pct FROM wide""")
def route_compare(spark, folder):
    """Shortest and risk-aware route per request, zones avoided and deltas."""
    nodes, edges, risk, requests = supplier_graph(spark, folder)
    rt = routes(edges, requests)
    c = RT.compare_routes(rt, RT.exposure(rt, edges, risk), digits=6)
    text = lambda p, sep: F.array_join(F.transform(p, lambda x: x.cast("string")), sep)
    return c.select("src", "dst", *[F.round(x, 4).alias(x) for x in ("base_cost", "aware_cost", "base_max_risk", "aware_max_risk")],
                    text("base_path", ">").alias("base_path"), text("aware_path", ">").alias("aware_path"), text("avoided", ",").alias("avoided"),
                    "distance_delta", "time_delta_min", "risk_reduction_pct")


@query("route_waypoints", f"""WITH {_RT} SELECT metric, src, dst, CAST(2 * len(path) - 1 AS INTEGER) AS n_points,
 {R('list_sum([CAST(x AS DOUBLE) FOR x IN path]) + list_sum([(path[i] + path[i + 1]) / 2e0 FOR i IN range(1, len(path))])', alias='sum_lat')} FROM rt""")
def route_waypoints(spark, folder):
    """Waypoints with midpoints (zones placed at their key); emitted as counts and sums."""
    nodes, edges, risk, requests = supplier_graph(spark, folder)
    centres = nodes.select("node", F.col("node").cast("double").alias("lat"), (F.col("node") % 7).cast("double").alias("lng"))
    w = RT.waypoints(routes(edges, requests), centres)
    return w.select("metric", "src", "dst", F.size("points").alias("n_points"),
                    F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["lat"]), 4).alias("sum_lat"))


@query("road_rejects", f"""WITH rd AS (SELECT s_suppkey * 10000 + st AS road_id, s_suppkey AS src, s_suppkey + st AS dst FROM supplier, (SELECT unnest({STEPS}) AS st) s)
SELECT road_id, 'unknown endpoint' AS reason FROM rd WHERE dst NOT IN (SELECT s_suppkey FROM supplier)""")
def road_rejects(spark, folder):
    """Roads that point past the last zone."""
    sup = RD.table(spark, folder, "supplier")
    roads = sup.select(F.col("s_suppkey").alias("src"), F.explode(F.array(*[F.lit(s).cast("long") for s in STEPS])).alias("step")).select(
        (F.col("src") * 10000 + F.col("step")).alias("road_id"), "src", (F.col("src") + F.col("step")).alias("dst"), F.lit(1.0).alias("length"))
    return RT.road_rejects(sup.select(F.col("s_suppkey").alias("node")), roads)
