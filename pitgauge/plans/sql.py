"""Common table expressions of the SQL twins (the adapters in plain SQL)."""

PANEL_W = "WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx)"

DENSE = """
ev AS (
  SELECT user_id % 5 AS seed, user_id AS zone_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day_idx,
         coalesce(sum(value) FILTER (WHERE event_type IN ('view','click')), 0e0) AS rainfall_mm,
         count(*) FILTER (WHERE event_type = 'purchase') AS n_blast,
         coalesce(max(value) FILTER (WHERE event_type = 'purchase') / 5e0, 0e0) AS ppv,
         count(*) FILTER (WHERE event_type = 'signup') AS n_inspect,
         count(*) FILTER (WHERE event_type = 'error') AS err,
         coalesce(sum(value) FILTER (WHERE event_type = 'error') / 100e0, 0e0) AS growth
  FROM events GROUP BY ALL),
grid AS (
  SELECT u.seed, u.zone_id, d.day_idx
  FROM (SELECT DISTINCT user_id % 5 AS seed, user_id AS zone_id FROM events) u,
       (SELECT CAST(unnest(range(0, date_diff('day', DATE '2024-01-01', max(CAST(ts AS DATE))) + 1)) AS INTEGER) AS day_idx
        FROM events) d),
dense AS (
  SELECT g.seed, g.zone_id, g.day_idx, coalesce(rainfall_mm, 0e0) AS rainfall_mm, coalesce(rainfall_mm, 0e0) > 0 AS wet_day,
         coalesce(n_blast, 0) > 0 AS blast_occurs, coalesce(ppv, 0e0) AS ppv, coalesce(n_inspect, 0) > 0 AS inspected,
         coalesce(err, 0) AS err, coalesce(growth, 0e0) AS growth
  FROM grid g LEFT JOIN ev ON ev.zone_id = g.zone_id AND ev.day_idx = g.day_idx)"""

PANEL = DENSE + """,
state AS (
  SELECT *, exp(-day_idx / 12e0) * sum(rainfall_mm / 10e0 * exp(day_idx / 12e0)) OVER w AS groundwater_proxy,
         least(2.5e0, 0.05e0 + 0.1e0 * sum(err) OVER w) AS crack_density
  FROM dense WINDOW w AS (PARTITION BY seed, zone_id ORDER BY day_idx ROWS UNBOUNDED PRECEDING)),
panel AS (
  SELECT *, least(100e0, 0.6e0 * groundwater_proxy + 15e0 * crack_density + 0.6e0 * ppv) AS score FROM state)"""

ORDERS_DAILY = """
od AS (
  SELECT 'S1' AS station_id, d.day, coalesce(v, 0e0) AS value
  FROM (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day
        FROM orders) d
  LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day,
                    sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') / 10000e0 AS v
             FROM orders GROUP BY 1) o USING (day))"""

LINEITEM_DAILY = """
ld AS (
  SELECT d.series, d.day, CAST(date_diff('day', DATE '1995-01-01', d.day) AS INTEGER) AS day_idx, coalesce(v, 0e0) AS value
  FROM (SELECT l_returnflag || l_linestatus AS series,
               CAST(unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day
        FROM lineitem GROUP BY 1) d
  LEFT JOIN (SELECT l_returnflag || l_linestatus AS series, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v
             FROM lineitem GROUP BY 1, 2) o USING (series, day))"""

SLOPES = """
slopes AS (
  SELECT p_partkey AS slope_id, CAST(29 + p_partkey % 130 AS DOUBLE) AS cohesion, CAST(25 + p_size % 15 AS DOUBLE) AS phi,
         CAST(18 + p_partkey % 6 AS DOUBLE) AS gamma, CAST(6 + p_size % 20 AS DOUBLE) AS height,
         CAST(45 + p_partkey % 30 AS DOUBLE) AS theta, CAST(45 + p_partkey % 30 AS DOUBLE) AS face,
         p_retailprice % 250e0 AS proxy, (p_size % 25) / 10e0 AS density,
         ['normal','minor','moderate','severe','critical'][p_size % 5 + 1] AS severity,
         p_partkey % 2 = 0 AS filled, CASE WHEN p_partkey % 17 = 0 THEN 'floor' ELSE 'bench' END AS zone_kind,
         CAST(490 + p_size AS DOUBLE) AS pore_kpa
  FROM part)"""

CELLS = """
cells AS (
  SELECT vec_id AS "row", CAST(i AS BIGINT) - 1 AS col, CAST(embedding[i] AS DOUBLE) * 100e0 AS elev
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


def band(x: str) -> str:
    return (f"CASE WHEN {x} < 50 THEN 'Very Low' WHEN {x} < 65 THEN 'Low' WHEN {x} < 75 THEN 'Moderate' "
            f"WHEN {x} < 85 THEN 'High' ELSE 'Critical' END")


def label(fos: str) -> str:
    return (f"CASE WHEN {fos} IS NULL THEN NULL WHEN {fos} < 0.8 THEN 'critical' WHEN {fos} < 1.0 THEN 'high' "
            f"WHEN {fos} < 1.2 THEN 'moderate' WHEN {fos} < 1.5 THEN 'low' ELSE 'very_low' END")


def severity(ratio: str) -> str:
    return (f"CASE WHEN {ratio} >= 0.49 THEN 'critical' WHEN {ratio} >= 0.33 THEN 'severe' WHEN {ratio} >= 0.20 THEN 'moderate' "
            f"WHEN {ratio} >= 0.10 THEN 'minor' ELSE 'normal' END")


def trend(keys: str = "seed, zone_id", order: str = "day_idx", score: str = "score") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY {order})"
    a, b, c = f"lag({score}, 2) {w}", f"lag({score}, 1) {w}", score
    return (f"CASE WHEN {a} IS NULL THEN 'stable' "
            f"WHEN ({b} - {a} >= 8 AND {c} - {b} >= 8) OR {c} - {a} >= 25 THEN 'rapidly_increasing' "
            f"WHEN {c} > {a} THEN 'rising' ELSE 'stable' END")
