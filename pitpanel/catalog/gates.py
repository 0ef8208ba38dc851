"""Gates, latest-as-of, lags and vintages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.catalog.base import Query, ZONES, day, i, r, shape, stamp, table
from pitpanel.functions import timecal
from pitpanel.operators import pointintime as pit
from pitpanel.operators import scoring
from pitpanel.operators.guards import missing_units

AS_OF = "2024-01-20"


def publications(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is a publication by its user for the day that opens at 08:00."""
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("unit"), "ts", "value",
        (F.col("ts") + F.expr("interval 16 hours")).cast("date").alias("day"),
    )


PUBLICATIONS_SQL = """
pub AS (SELECT event_id, user_id AS unit, ts, value, CAST(ts + INTERVAL 16 HOUR AS DATE) AS day FROM events)
"""


def _gate(gate: pit.Gate):
    def build(spark: SparkSession, sf: str) -> DataFrame:
        chosen = pit.select_at_gate(publications(spark, sf), gate=gate, day="day", unit="unit", published="ts",
                                    value="value", tie_break=["event_id"])
        return shape(chosen, day="date", unit="int", value="double:4", ts="stamp")

    return build


def _gate_sql(condition: str, direction: str) -> str:
    return f"""
WITH {PUBLICATIONS_SQL}
SELECT {day('day')} AS day, {i('unit')} AS unit, {r('value')} AS value, {stamp('ts')} AS ts
FROM pub WHERE {condition}
QUALIFY row_number() OVER (PARTITION BY day, unit ORDER BY ts {direction}, event_id {direction}) = 1
"""


_BEFORE = "CAST(ts AS DATE) < day"
_OPEN = "(CAST(ts AS DATE) < day OR (CAST(ts AS DATE) = day AND hour(ts) < 5))"


def business_day_totals(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    out = events.groupBy(timecal.business_day("ts").alias("business_day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
    return shape(out, business_day="date", event_type="text", n="int", total="double:4")


BUSINESS_DAY_SQL = f"""
SELECT {day('CAST(ts - INTERVAL 5 HOUR AS DATE)')} AS business_day, event_type, {i('count(*)')} AS n,
       {r('sum(value)')} AS total
FROM events GROUP BY 1, 2
"""

SCORE_GROUPINGS = ((), ("day_type",), ("unit",))


def point_in_time_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Gate the publications, compare them and a week-old outcome with the outcome, score."""
    forecast = pit.select_at_gate(publications(spark, sf), day="day", unit="unit", published="ts", value="value",
                                  tie_break=["event_id"]).select("day", "unit", F.col("value").alias("published"))
    outcome = table(spark, sf, "events").groupBy(
        timecal.business_day("ts").alias("day"), F.col("user_id").alias("unit")
    ).agg(F.avg("value").alias("actual"))
    panel = pit.seasonal_naive(outcome, units=["unit"], time="day", value="actual").join(
        forecast, ["day", "unit"], "left"
    ).withColumn("day_type", timecal.day_type("day", F.lit(False)))
    scores = scoring.score(panel, actual="actual", forecasts={"published": "published", "naive": "seasonal_naive"},
                           groupings=SCORE_GROUPINGS)
    return shape(scores, grouping="text", day_type="text", unit="text", model="text", n="int", mae="double:4",
                 rmse="double:4", bias="double:4", mape_pct="double:3")


POINT_IN_TIME_SQL = f"""
WITH {PUBLICATIONS_SQL},
fc AS (SELECT day, unit, value AS published FROM pub WHERE {_BEFORE}
       QUALIFY row_number() OVER (PARTITION BY day, unit ORDER BY ts DESC, event_id DESC) = 1),
act AS (SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) AS day, user_id AS unit, avg(value) AS actual
        FROM events GROUP BY 1, 2),
panel AS (SELECT a.unit, a.actual, b.actual AS naive, f.published,
                 CASE isodow(a.day) - 1 WHEN 5 THEN 'saturday' WHEN 6 THEN 'sunday' ELSE 'weekday' END AS day_type
          FROM act a JOIN act b ON a.unit = b.unit AND b.day = a.day - 7
                     JOIN fc f ON a.unit = f.unit AND a.day = f.day),
long AS (SELECT unit, day_type, actual, 'published' AS model, published AS f FROM panel
         UNION ALL SELECT unit, day_type, actual, 'naive', naive FROM panel)
SELECT CASE WHEN grouping(day_type) = 0 THEN 'day_type' WHEN grouping(unit) = 0 THEN 'unit' ELSE 'all' END AS grouping,
       day_type, CAST(unit AS VARCHAR) AS unit, model, {i('count(*)')} AS n,
       {r('avg(abs(f - actual))')} AS mae, {r('sqrt(avg((f - actual) * (f - actual)))')} AS rmse,
       {r('avg(f - actual)')} AS bias, {r('avg(abs(f - actual) / nullif(abs(actual), 0)) * 100', 3)} AS mape_pct
FROM long GROUP BY GROUPING SETS ((model), (day_type, model), (unit, model))
"""


def seasonal_naive_7d(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "orders").groupBy(
        (F.col("o_custkey") % ZONES).alias("unit"), F.col("o_orderdate").cast("date").alias("day")
    ).agg(F.sum("o_totalprice").alias("y"))
    out = pit.seasonal_naive(daily, units=["unit"], time="day", value="y", output="naive")
    return shape(out, unit="int", day="date", y="double:2", naive="double:2")


SEASONAL_NAIVE_SQL = f"""
WITH d AS (SELECT o_custkey % {ZONES} AS unit, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS y
           FROM orders GROUP BY 1, 2)
SELECT {i('a.unit')} AS unit, {day('a.day')} AS day, {r('a.y', 2)} AS y, {r('b.y', 2)} AS naive
FROM d a LEFT JOIN d b ON a.unit = b.unit AND b.day = a.day - 7
"""


def latest_event_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Events of type view carry no entity id and stand for themselves."""
    events = table(spark, sf, "events").withColumn(
        "entity", F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("user_id").cast("string"))
    )
    out = pit.latest_as_of(
        events, key=pit.entity_key("entity", "event_id"), recorded="ts", record="event_id",
        as_of=f"{AS_OF} 00:00:00", keep=["ts", "event_id", "event_type", "value"],
    )
    return shape(out, entity_key="text", ts="stamp", event_id="int", event_type="text", value="double:4")


LATEST_EVENT_SQL = f"""
WITH k AS (SELECT *, CASE WHEN event_type = 'view' THEN 'record ' || event_id ELSE 'entity ' || user_id END AS entity_key
           FROM events WHERE ts <= TIMESTAMP '{AS_OF} 00:00:00')
SELECT entity_key, {stamp('ts')} AS ts, {i('event_id')} AS event_id, event_type, {r('value')} AS value
FROM k QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY ts DESC, event_id DESC) = 1
"""


def latest_order_as_of(spark: SparkSession, sf: str) -> DataFrame:
    out = pit.latest_as_of(
        table(spark, sf, "orders"), key=F.col("o_custkey"), key_name="custkey", recorded="o_orderdate",
        record="o_orderkey", as_of="1999-12-31 00:00:00",
        keep=["o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice"],
    )
    return shape(out, custkey="int", o_orderdate="date", o_orderkey="int", o_orderstatus="text", o_totalprice="double:2")


LATEST_ORDER_SQL = f"""
SELECT {i('o_custkey')} AS custkey, {day('o_orderdate')} AS o_orderdate, {i('o_orderkey')} AS o_orderkey,
       o_orderstatus, {r('o_totalprice', 2)} AS o_totalprice
FROM orders WHERE o_orderdate <= TIMESTAMP '1999-12-31'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
"""


def last_row_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Line keys repeat; the last by date, part and supplier wins."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    out = pit.latest_per_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order=order, keep=order)
    return shape(out, l_orderkey="int", l_linenumber="int", l_shipdate="date", l_partkey="int", l_suppkey="int",
                 l_quantity="double:2", l_extendedprice="double:2")


LAST_ROW_SQL = f"""
SELECT {i('l_orderkey')} AS l_orderkey, {i('l_linenumber')} AS l_linenumber, {day('l_shipdate')} AS l_shipdate,
       {i('l_partkey')} AS l_partkey, {i('l_suppkey')} AS l_suppkey, {r('l_quantity', 2)} AS l_quantity,
       {r('l_extendedprice', 2)} AS l_extendedprice
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1
"""


def vintage_revision_stats(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("first"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("final"),
    )
    out = pit.revision_stats(lines, first="first", final="final")
    return shape(out, n="int", mean_revision="double:4", mean_abs_revision="double:4", pct_of_mean_level="double:4",
                 share_equal="double:6")


REVISION_SQL = f"""
WITH p AS (SELECT l_extendedprice AS a, l_extendedprice * (1 + l_tax) AS b FROM lineitem)
SELECT {i('count(*)')} AS n, {r('avg(b - a)')} AS mean_revision, {r('avg(abs(b - a))')} AS mean_abs_revision,
       {r('avg(abs(b - a)) / avg(a) * 100')} AS pct_of_mean_level,
       {r('avg(CASE WHEN abs(b - a) < 1e-9 THEN 1.0 ELSE 0.0 END)', 6)} AS share_equal
FROM p
"""


def vintage_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Shipments per (part, supplier) as known at a date, and in the end."""
    lines = table(spark, sf, "lineitem")

    out = pit.restated_totals(lines, F.col("l_shipdate") <= "1998-06-30", keys=["l_partkey", "l_suppkey"], totals={"qty": "l_quantity"})
    return shape(out, l_partkey="int", l_suppkey="int", qty_old="double:2", qty_new="double:2", change="text")


VINTAGE_DIFF_SQL = f"""
WITH a AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty FROM lineitem
           WHERE l_shipdate <= '1998-06-30' GROUP BY 1, 2),
b AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)
SELECT {i('coalesce(a.l_partkey, b.l_partkey)')} AS l_partkey, {i('coalesce(a.l_suppkey, b.l_suppkey)')} AS l_suppkey,
       {r('a.qty', 2)} AS qty_old, {r('b.qty', 2)} AS qty_new,
       CASE WHEN a.l_partkey IS NULL THEN 'added' WHEN b.l_partkey IS NULL THEN 'removed'
            WHEN a.qty IS NOT DISTINCT FROM b.qty THEN 'same' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey
"""


def anti_unseen_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Early orders of customers who did not return late."""
    orders = table(spark, sf, "orders")
    late = orders.filter(F.col("o_orderdate") >= "2000-06-01")
    early = orders.filter(F.col("o_orderdate") < "2000-06-01")
    return shape(pit.unseen(early, late, ["o_custkey"]), o_orderkey="int", o_custkey="int", o_orderdate="date")


ANTI_SQL = f"""
SELECT {i('o_orderkey')} AS o_orderkey, {i('o_custkey')} AS o_custkey, {day('o_orderdate')} AS o_orderdate
FROM orders e WHERE o_orderdate < TIMESTAMP '2000-06-01'
  AND NOT EXISTS (SELECT 1 FROM orders l WHERE l.o_custkey = e.o_custkey AND l.o_orderdate >= TIMESTAMP '2000-06-01')
"""


def missing_customer_years(spark: SparkSession, sf: str) -> DataFrame:
    """(customer, year) cells without an order."""
    years = F.explode(F.sequence(F.lit(1995), F.lit(2001)))
    cells = table(spark, sf, "customer").select("c_custkey", years.alias("y")).select(F.concat_ws("/", "c_custkey", "y").alias("cell"))
    orders = table(spark, sf, "orders").select(F.concat_ws("/", "o_custkey", F.year("o_orderdate")).alias("cell"))
    return shape(missing_units(orders, "cell", cells), cell="text")


MISSING_SQL = """
SELECT cell FROM (SELECT c_custkey || '/' || y AS cell FROM customer, (SELECT unnest(range(1995, 2002)) AS y))
WHERE cell NOT IN (SELECT o_custkey || '/' || year(o_orderdate) FROM orders)
"""


QUERIES = [
    Query("point_in_time_scores", point_in_time_scores, POINT_IN_TIME_SQL, "T5 E1 C11 B12 D6 D7 D8 T9"),
    Query("gate_last_before_day", _gate(pit.Gate.LAST_BEFORE_DAY), _gate_sql(_BEFORE, "DESC"), "E1 C12"),
    Query("gate_first_before_day", _gate(pit.Gate.FIRST_BEFORE_DAY), _gate_sql(_BEFORE, "ASC"), "E1 C12"),
    Query("gate_before_day_start", _gate(pit.Gate.LAST_BEFORE_OPEN), _gate_sql(_OPEN, "DESC"), "E1 C12"),
    Query("business_day_totals", business_day_totals, BUSINESS_DAY_SQL, "T5"),
    Query("seasonal_naive_7d", seasonal_naive_7d, SEASONAL_NAIVE_SQL, "C11"),
    Query("latest_per_entity_asof", latest_event_as_of, LATEST_EVENT_SQL, "E3"),
    Query("latest_order_asof", latest_order_as_of, LATEST_ORDER_SQL, "E3"),
    Query("last_row_per_key", last_row_per_key, LAST_ROW_SQL, "E2"),
    Query("vintage_revision_stats", vintage_revision_stats, REVISION_SQL, "D16"),
    Query("vintage_diff", vintage_diff, VINTAGE_DIFF_SQL, "A20"),
    Query("anti_unseen_keys", anti_unseen_keys, ANTI_SQL, "C8"),
    Query("missing_units", missing_customer_years, MISSING_SQL, "D21 G2"),
]
