"""Nested feeds, snapshots and streams over the events table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.catalog.base import Query, day, i, r, shape, stamp, table
from pitpanel.catalog.gates import PUBLICATIONS_SQL
from pitpanel.operators import guards
from pitpanel.operators.pointintime import Gate
from pitpanel.session import ensure_checkpoint_dir
from pitpanel.sources import nested
from pitpanel.sources.snapshot import content_hash
from pitpanel.streaming import live


def json_events_props(spark: SparkSession, sf: str) -> DataFrame:
    props = T.StructType([T.StructField("k", T.LongType())])
    parsed = table(spark, sf, "events").select("event_type", "value", F.from_json("props", props)["k"].alias("k"))
    out = parsed.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k_sum"),
                                           F.sum(F.col("k") * F.col("value")).alias("kv"))
    return shape(out, event_type="text", n="int", k_sum="int", kv="double:2")


JSON_SQL = f"""
WITH p AS (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, {i('count(k)')} AS n, {i('sum(k)')} AS k_sum, {r('sum(k * value)', 2)} AS kv FROM p GROUP BY 1
"""


def json_hourly_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a response with two readings at one location, flattened back to rows."""
    clock = "yyyy-MM-dd'T'HH:mm:ss"
    times = F.array(F.date_format("ts", clock), F.date_format(F.col("ts") + F.expr("interval 30 minutes"), clock))
    values = F.array(F.col("value").cast("string"), F.get_json_object("props", "$.k"))
    location = F.struct(F.struct(times.alias("time"), values.alias("temperature_2m")).alias("hourly"))
    responses = table(spark, sf, "events").select(F.to_json(F.array(location)).alias("body"), F.array("event_type").alias("point_ids"))
    rows = nested.hourly_rows(responses, variable="temperature_2m", value="temp_c_realised")
    out = rows.groupBy("point_id", F.col("time_utc").cast("date").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("temp_c_realised").alias("total"), F.max("time_utc").alias("last"))
    return shape(out, point_id="text", d="date", n="int", total="double:3", last="stamp")


HOURLY_SQL = f"""
WITH e AS (SELECT event_type, date_trunc('second', ts) AS t, value AS v FROM events
           UNION ALL SELECT event_type, date_trunc('second', ts + INTERVAL 30 MINUTE), CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events)
SELECT event_type AS point_id, {day('CAST(t AS DATE)')} AS d, {i('count(*)')} AS n, {r('sum(v)', 3)} AS total, {stamp('max(t)')} AS last
FROM e GROUP BY event_type, CAST(t AS DATE)
"""


def cut_and_scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation cut by an explicit as-of date, then the complete rows from a start date."""
    events = table(spark, sf, "events").select(
        "event_id", "ts", F.col("ts").cast("date").alias("d"), "value",
        F.when(F.col("event_type") != "error", F.col("value")).alias("incumbent"),
        F.get_json_object("props", "$.k").cast("double").alias("headline"),
    )
    cut = guards.up_to(events, "d", "2024-01-28", lag_days=2)
    out = guards.scored_rows(cut, time="d", start="2024-01-10", needed=["value", "incumbent", "headline"])
    return shape(out, event_id="int", d="date", value="double:2", headline="double:2")


SCORED_SQL = f"""
SELECT {i('event_id')} AS event_id, {day('CAST(ts AS DATE)')} AS d, {r('value', 2)} AS value,
       {r("CAST(json_extract_string(props, '$.k') AS DOUBLE)", 2)} AS headline
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-26' AND event_type <> 'error'
  AND value IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL
"""


def shared_key_check(spark: SparkSession, sf: str) -> DataFrame:
    """Customers on both sides of a date, the leak a split must not have."""
    orders = table(spark, sf, "orders")
    train = orders.filter(F.col("o_orderdate") < "1998-06-01")
    test = orders.filter(F.col("o_orderdate") >= "1998-06-01")
    return shape(guards.shared_keys(train, test, ["o_custkey"]), o_custkey="int")


SHARED_SQL = f"""
SELECT {i('o_custkey')} AS o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01'
INTERSECT SELECT {i('o_custkey')} FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01'
"""


def snapshot_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Order-insensitive content hash of the line items; hash functions differ between engines."""
    return shape(content_hash(table(spark, sf, "lineitem")), rows="int", content_hash="text")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _run(spark: SparkSession, build: Callable[[str], DataFrame]) -> DataFrame:
    """Drain an append stream into files on the shared checkpoint folder, end its feed, drain the rest, and read them.

    ``build`` makes the stream from the folder of end-of-feed markers; both runs share one
    checkpoint, as after a restart.
    """
    root = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    live.open_feed(spark, f"{root}/ended", flag="ended")
    for last in (False, True):
        if last:
            live.end_feed(spark, f"{root}/ended", flag="ended")
        stream = build(f"{root}/ended")
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def stream_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Live gate over the event file: equal to the batch gate on every day once the feed has ended."""
    def build(markers: str) -> DataFrame:
        pubs = _event_stream(spark, sf).select(
            "event_id", F.col("user_id").alias("unit"), "ts", "value",
            (F.col("ts") + F.expr("interval 16 hours")).cast("date").alias("day"),
        )
        return live.live_gate(live.with_markers(pubs, markers, flag="ended"), day="day", unit="unit", published="ts", value="value",
                              tie_break="event_id", gate=Gate.LAST_BEFORE_DAY, horizon="2 days", ended="ended")

    return shape(_run(spark, build), day="date", unit="int", value="double:4", ts="stamp")


STREAM_GATE_SQL = f"""
WITH {PUBLICATIONS_SQL}, ok AS (SELECT * FROM pub WHERE CAST(ts AS DATE) < day)
SELECT {day('day')} AS day, {i('unit')} AS unit, {r('value')} AS value, {stamp('ts')} AS ts
FROM ok QUALIFY row_number() OVER (PARTITION BY day, unit ORDER BY ts DESC, event_id DESC) = 1
"""


def stream_business_day(spark: SparkSession, sf: str) -> DataFrame:
    """Live business-day totals over the event file: equal to the batch totals once the feed has ended."""
    def build(markers: str) -> DataFrame:
        return live.live_business_days(
            live.with_markers(_event_stream(spark, sf), markers, flag="ended"), time="ts", keys=["event_type"],
            aggregates=[F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")], start_hour=5, lateness="1 hour", ended="ended",
        )

    return shape(_run(spark, build), business_day="date", event_type="text", n="int", total="double:4")


STREAM_DAY_SQL = f"""
WITH b AS (SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) AS d, event_type, value FROM events)
SELECT {day('d')} AS business_day, event_type, {i('count(*)')} AS n, {r('sum(value)')} AS total FROM b GROUP BY 1, 2
"""


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Latest event per user kept by a micro-batch log."""
    root = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    keys, order = ["user_id"], ["ts", "event_id"]
    source = _event_stream(spark, sf).select("user_id", "ts", "event_id", "event_type", "value")
    query = (
        source.writeStream.foreachBatch(live.append_latest(f"{root}/log", keys=keys, order=order))
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = live.current_state(spark, f"{root}/log", keys=keys, order=order)
    return shape(out, user_id="int", ts="stamp", event_id="int", event_type="text", value="double:4")


STREAM_UPSERT_SQL = f"""
SELECT {i('user_id')} AS user_id, {stamp('ts')} AS ts, {i('event_id')} AS event_id, event_type, {r('value')} AS value
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""

QUERIES = [
    Query("json_events_props", json_events_props, JSON_SQL, "A7 A12"),
    Query("json_hourly_arrays", json_hourly_arrays, HOURLY_SQL, "A7 A9"),
    Query("cut_and_scored_rows", cut_and_scored_rows, SCORED_SQL, "B6 B11"),
    Query("shared_key_check", shared_key_check, SHARED_SQL, "G4"),
    Query("snapshot_hash", snapshot_hash, None, "A19"),
    Query("stream_gate", stream_gate, STREAM_GATE_SQL, "S1"),
    Query("stream_business_day", stream_business_day, STREAM_DAY_SQL, "S2"),
    Query("stream_upsert", stream_upsert, STREAM_UPSERT_SQL, "S3"),
]
