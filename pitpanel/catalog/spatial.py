"""Grid weights, weighted means and degree days; event value and hour stand for a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.catalog.base import Query, day, i, r, shape, table
from pitpanel.operators import spatial


def grid_weights(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "events").select(
        F.col("value").alias("latitude"), (F.hour("ts") + F.minute("ts") / 60.0).alias("longitude"),
        F.get_json_object("props", "$.k").cast("double").alias("population"),
    )
    out = spatial.grid_weights(points, lat_step=25.0, lon_step=4.0, coverage=0.9)
    return shape(out, point_id="text", latitude="double:6", longitude="double:6", population="double:2", weight="double:8")


GRID_SQL = f"""
WITH p AS (SELECT value AS lat, hour(ts) + minute(ts) / 60.0 AS lon, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS m
           FROM events),
c AS (SELECT CAST(floor(lat / 25.0) AS BIGINT) AS a, CAST(floor(lon / 4.0) AS BIGINT) AS b, sum(m) AS pop,
             sum(lat * m) / sum(m) AS lat, sum(lon * m) / sum(m) AS lon FROM p WHERE m > 0 GROUP BY 1, 2),
s AS (SELECT *, sum(pop) OVER (ORDER BY pop DESC, a, b ROWS UNBOUNDED PRECEDING) / sum(pop) OVER () AS share FROM c),
k AS (SELECT *, coalesce(lag(share) OVER (ORDER BY pop DESC, a, b), 0.0) AS before FROM s)
SELECT printf('c%+03d%+03d', a, b) AS point_id, {r('lat', 6)} AS latitude, {r('lon', 6)} AS longitude,
       {r('pop', 2)} AS population, {r('pop / sum(pop) OVER ()', 8)} AS weight
FROM k WHERE before <= 0.9
"""


def coverage_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Fewest (brand, type) pairs that make up 60 % of revenue: a fixed number of cells."""
    cells = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey"
    ).groupBy("p_brand", "p_type").agg(F.sum("l_extendedprice").alias("revenue"))
    out = spatial.coverage_cut(cells, size="revenue", tie_break=["p_brand", "p_type"], coverage=0.6, share="running_share")
    return shape(out, p_brand="text", p_type="text", revenue="double:2", running_share="double:6")


COVERAGE_TOPK_SQL = f"""
WITH c AS (SELECT p_brand, p_type, sum(l_extendedprice) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
s AS (SELECT *, sum(revenue) OVER (ORDER BY revenue DESC, p_brand, p_type ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER () AS share FROM c),
k AS (SELECT *, coalesce(lag(share) OVER (ORDER BY revenue DESC, p_brand, p_type), 0.0) AS before FROM s)
SELECT p_brand, p_type, {r('revenue', 2)} AS revenue, {r('share', 6)} AS running_share FROM k WHERE before <= 0.6
"""


def weighted_mean_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly value as a mean over event types, weighted by the types' overall volume."""
    events = table(spark, sf, "events")
    weights = events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("double")).alias("weight"))
    values = events.groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type").agg(F.avg("value").alias("value"))
    out = spatial.weighted_mean(values, weights, time="week", cell="event_type", value="value", unique_cells=True)
    return shape(out, week="date", value="double:6")


WEIGHTED_SQL = f"""
WITH w AS (SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS w FROM events GROUP BY 1),
v AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT {day('week')} AS week, {r('sum(v * w) / sum(w)', 6)} AS value FROM v JOIN w USING (event_type) GROUP BY week
"""


def degree_day_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as temperatures: hourly means, then degree days of the local day."""
    hourly = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time_utc")).agg(
        (F.avg("value") / 5.0).alias("temp_c_realised")
    )
    out = spatial.degree_days(hourly, time="time_utc", value="temp_c_realised", tz="America/New_York", base_c=15.5, min_hours=20)
    return shape(out, settlement_date="date", mean_temp_c="double:6", hdd="double:6", n_hours="int")


DEGREE_SQL = f"""
WITH h AS (SELECT date_trunc('hour', ts) AS t, avg(value) / 5.0 AS temp FROM events GROUP BY 1),
d AS (SELECT CAST(timezone('America/New_York', timezone('UTC', t)) AS DATE) AS d, avg(temp) AS m, count(*) AS n FROM h GROUP BY 1)
SELECT {day('d')} AS settlement_date, {r('m', 6)} AS mean_temp_c, {r('greatest(15.5 - m, 0.0)', 6)} AS hdd, {i('n')} AS n_hours
FROM d WHERE n >= 20
"""

QUERIES = [
    Query("grid_weights", grid_weights, GRID_SQL, "D1 E4 F2"),
    Query("coverage_topk", coverage_topk, COVERAGE_TOPK_SQL, "E4 F2"),
    Query("weighted_mean_by_time", weighted_mean_by_time, WEIGHTED_SQL, "C6 D2"),
    Query("degree_day_daily", degree_day_daily, DEGREE_SQL, "D3 H10"),
]
