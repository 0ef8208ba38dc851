"""Guards, holiday bodies, sinks and diagnostics that no other catalogue query covers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.catalog.base import Query, ZONE_MONTHS_SQL, day, i, r, shape, stamp, table, zone_months
from pitpanel.catalog.inference import LEAVE_OUT_SQL
from pitpanel.functions import timecal
from pitpanel.operators import guards
from pitpanel.operators import interaction as inter
from pitpanel.operators import simulation as sim
from pitpanel.session import ensure_checkpoint_dir
from pitpanel.sources.nested import holiday_rows
from pitpanel.sources.snapshot import write_table


def guarded_order_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders through every guard, then totals by status: all of them let clean rows pass unchanged."""
    orders = guards.require_columns(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"])
    guards.assert_point_in_time(orders.columns)
    guards.refuse_rows(orders, F.col("o_totalprice") < 0, "o_orderkey", "orders cost less than nothing")
    guards.require_same_codes(orders, "o_orderstatus", spark.createDataFrame([(c,) for c in "FOP"], "o_orderstatus string"))
    checked = orders.withColumn("o_totalprice", guards.assert_in_plan(F.col("o_totalprice"), F.col("o_totalprice").isNull(), "no price"))
    out = checked.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return shape(out, o_orderstatus="text", n="int", total="double:2")


GUARDED_SQL = f"SELECT o_orderstatus, {i('count(*)')} AS n, {r('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1"


def refusals(spark: SparkSession, sf: str) -> DataFrame:
    """What the row guard says of orders above a price: their number, and that it shows three of them."""
    orders = table(spark, sf, "orders")
    try:
        guards.refuse_rows(orders, F.col("o_totalprice") > 100000, "o_orderkey", "orders cost too much")
        count, shown = 0, []
    except guards.DataGuardError as error:
        head, _, tail = str(error).partition(" orders cost too much; examples: ")
        count, shown = int(head), [int(x) for x in tail.strip("[]").replace("'", "").split(", ")]
    found = orders.filter((F.col("o_totalprice") > 100000) & F.col("o_orderkey").isin(shown)).select("o_orderkey").distinct()
    return shape(found.agg(F.count(F.lit(1)).alias("examples")).select(F.lit(count).alias("refused"), "examples"),
                 refused="int", examples="int")


REFUSALS_SQL = f"""SELECT {i('count(*)')} AS refused, {i('least(3, count(DISTINCT o_orderkey))')} AS examples
FROM orders WHERE o_totalprice > 100000"""


def union_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Order years landed one table each, read back and joined to one series."""
    root = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    orders.write.partitionBy("y").parquet(root)
    parts = [spark.read.parquet(f"{root}/y={y}") for y in sorted(r["y"] for r in orders.select("y").distinct().collect())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return shape(out, month="date", n="int", total="double:2")


UNION_SQL = f"""SELECT {day("date_trunc('month', o_orderdate)")} AS month, {i('count(*)')} AS n, {r('sum(o_totalprice)', 2)} AS total
FROM orders GROUP BY 1"""


def ordered_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Part sizes written in order as CSV and read back, with the largest step down between neighbours of one file."""
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    write_table(table(spark, sf, "part").select("p_partkey", "p_size"), path, fmt="csv", order=["p_partkey"])
    back = spark.read.csv(path, header=True, schema="p_partkey bigint, p_size int")
    files = back.withColumn("file", F.input_file_name()).groupBy("file").agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
    later = files.select(F.col("file").alias("file_b"), F.col("lo").alias("lo_b"))
    overlaps = files.join(later, (F.col("file") < F.col("file_b")) & (F.col("hi") > F.col("lo_b"))).count()
    return shape(back.withColumn("overlapping_files", F.lit(overlaps)), p_partkey="int", p_size="int", overlapping_files="int")


SINK_SQL = f"SELECT {i('p_partkey')} AS p_partkey, {i('p_size')} AS p_size, {i('0')} AS overlapping_files FROM part"


def holiday_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Landed maps of divisions (the nations) to dated events (their urgent orders), a body for each order month, read for all divisions."""
    nation = table(spark, sf, "nation")
    urgent = (table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
              .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", "o_orderdate"))
    event = F.struct(F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    month = F.trunc("o_orderdate", "month").alias("month")
    lists = nation.join(urgent, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(month, "n_name").agg(F.collect_list(event).alias("events"))
    divisions = [row["n_name"] for row in nation.select("n_name").collect()]  # a bounded table
    months = lists.groupBy("month").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "events"))).alias("found"))
    none = F.array().cast("array<struct<title: string, date: string>>")
    whole = F.transform(F.array(*map(F.lit, divisions)), lambda name: F.struct(
        name, F.struct(F.coalesce(F.try_element_at("found", name), none).alias("events"))))
    bodies = months.select(F.to_json(F.map_from_entries(whole)).alias("body"))
    return shape(holiday_rows(bodies, divisions), date="date", division="text", title="text")


HOLIDAY_SQL = f"""
WITH u AS (SELECT n_name, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
           WHERE o_orderpriority = '1-URGENT')
SELECT {day('o_orderdate')} AS date, n_name AS division, 'order ' || o_orderkey AS title
FROM u
"""


def business_day_opening(spark: SparkSession, sf: str) -> DataFrame:
    """When each event's business day opened, and events by hours since then."""
    events = table(spark, sf, "events")
    opened = timecal.business_day_start(timecal.business_day("ts"))
    out = events.groupBy(opened.alias("opened")).agg(F.count(F.lit(1)).alias("n"))
    return shape(out, opened="stamp", n="int")


OPENING_SQL = f"""SELECT {stamp("CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 5 HOUR")} AS opened, {i('count(*)')} AS n
FROM events GROUP BY 1"""


def pooled_fit(spark: SparkSession, sf: str) -> DataFrame:
    out = sim.linear_fit(zone_months(spark, sf), outcome="y", regressors=["x"])
    return shape(out, term="text", coefficient="double:5", r_squared="double:7", n="int")


POOLED_SQL = f"""
WITH {ZONE_MONTHS_SQL}
SELECT 'intercept' AS term, {r('regr_intercept(y, x)', 5)} AS coefficient, {r('regr_r2(y, x)', 7)} AS r_squared, {i('count(*)')} AS n FROM zm
UNION ALL SELECT 'x', {r('regr_slope(y, x)', 5)}, {r('regr_r2(y, x)', 7)}, {i('count(*)')} FROM zm
"""


def principal_shares(spark: SparkSession, sf: str) -> DataFrame:
    out = sim.component_shares(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return shape(out, component="int", eigenvalue="double:6", variance_share="double:6")


SHARES_SQL = f"""
WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a FROM lineitem)
SELECT {i('1')} AS component, {r('1 + a', 6)} AS eigenvalue, {r('(1 + a) / 2', 6)} AS variance_share FROM c
UNION ALL SELECT {i('2')}, {r('1 - a', 6)}, {r('(1 - a) / 2', 6)} FROM c
"""


def leave_out_signs(spark: SparkSession, sf: str) -> DataFrame:
    left_out = sim.leave_one_unit_out(zone_months(spark, sf), outcome="y", regressor="x", unit="unit", period="month", balanced=True)
    return shape(sim.sign_consistency(left_out), n_units="int", min_estimate="double:5", max_estimate="double:5", share_same_sign="double:6")


SIGNS_SQL = f"""
SELECT {i('count(*)')} AS n_units, {r('min(estimate)', 5)} AS min_estimate, {r('max(estimate)', 5)} AS max_estimate,
       {r('greatest(avg(CAST(estimate > 0 AS INT)), 1 - avg(CAST(estimate > 0 AS INT)))', 6)} AS share_same_sign
FROM ({LEAVE_OUT_SQL})
"""


def family_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Bonferroni thresholds by market segment, the share of large orders of a customer standing in for p."""
    tests = (table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
             .groupBy("c_mktsegment", "c_custkey").agg(F.avg((F.col("o_totalprice") > 20000).cast("double")).alias("wild_p_value")))
    out = inter.with_threshold(tests, family="c_mktsegment", alpha=0.05)
    return shape(out, c_mktsegment="text", c_custkey="int", threshold="double:9", significant="int")


THRESHOLD_SQL = f"""
WITH t AS (SELECT c_mktsegment, c_custkey, avg(CASE WHEN o_totalprice > 20000 THEN 1.0 ELSE 0.0 END) AS p
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_mktsegment, {i('c_custkey')} AS c_custkey, {r('0.05 / count(*) OVER (PARTITION BY c_mktsegment)', 9)} AS threshold,
       {i('p <= 0.05 / count(*) OVER (PARTITION BY c_mktsegment)')} AS significant FROM t
"""


QUERIES = [
    Query("guarded_order_totals", guarded_order_totals, GUARDED_SQL, "B8 B9 B10 G3"),
    Query("refusals", refusals, REFUSALS_SQL, "B10 F3"),
    Query("union_of_parts", union_of_parts, UNION_SQL, "G1"),
    Query("ordered_sink", ordered_sink, SINK_SQL, "F1 A21"),
    Query("holiday_bodies", holiday_bodies, HOLIDAY_SQL, "A12"),
    Query("business_day_opening", business_day_opening, OPENING_SQL, "T6"),
    Query("pooled_fit", pooled_fit, POOLED_SQL, "P9"),
    Query("principal_shares", principal_shares, SHARES_SQL, "P9"),
    Query("leave_out_signs", leave_out_signs, SIGNS_SQL, "P9"),
    Query("family_thresholds", family_thresholds, THRESHOLD_SQL, "H13"),
]
