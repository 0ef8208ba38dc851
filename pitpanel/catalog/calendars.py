"""Clock, calendar and parsing queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.catalog.base import Query, day, i, r, shape, stamp, table
from pitpanel.functions import parsing, timecal
from pitpanel.operators import calendar as cal

TZ = "Europe/London"


def order_dates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()


_DATES_SQL = "dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"


def _midnight_sql(expr: str) -> str:
    return f"timezone('UTC', timezone('{TZ}', CAST({expr} AS TIMESTAMP)))"


def local_midnight_utc(spark: SparkSession, sf: str) -> DataFrame:
    out = order_dates(spark, sf).withColumn("midnight_utc", timecal.local_midnight_utc("d", TZ))
    return shape(out, d="date", midnight_utc="stamp")


LOCAL_MIDNIGHT_SQL = f"WITH {_DATES_SQL} SELECT {day('d')} AS d, {stamp(_midnight_sql('d'))} AS midnight_utc FROM dates"


def periods_per_local_day(spark: SparkSession, sf: str) -> DataFrame:
    out = order_dates(spark, sf).withColumn("n_periods", timecal.periods_in_local_day("d", TZ))
    return shape(out, d="date", n_periods="int")


_PERIODS_SQL = (f"CAST(date_diff('minute', {_midnight_sql('d')}, {_midnight_sql('d + 1')}) / 30 AS BIGINT)")

PERIODS_SQL = f"WITH {_DATES_SQL} SELECT {day('d')} AS d, {_PERIODS_SQL} AS n_periods FROM dates"


def period_end_utc(spark: SparkSession, sf: str) -> DataFrame:
    """Every half hour of every order date, with its model group."""
    dates = order_dates(spark, sf)
    rows = dates.withColumn("period", F.explode(F.sequence(F.lit(1), timecal.periods_in_local_day("d", TZ))))
    out = rows.withColumns({
        "end_utc": timecal.period_end_utc("d", "period", TZ),
        "model_period": timecal.folded_period("period"),
    })
    return shape(out, d="date", period="int", end_utc="stamp", model_period="int")


PERIOD_END_SQL = f"""
WITH {_DATES_SQL}, p AS (SELECT d, unnest(range(1, {_PERIODS_SQL} + 1)) AS period FROM dates)
SELECT {day('d')} AS d, {i('period')} AS period,
       {stamp(_midnight_sql('d') + " + to_minutes(CAST(30 * period AS BIGINT))")} AS end_utc,
       {i('least(period, 48)')} AS model_period
FROM p
"""


def local_clock_utc(spark: SparkSession, sf: str) -> DataFrame:
    """Event times read as local wall clock."""
    out = table(spark, sf, "events").select(
        "event_id", timecal.local_clock_utc("ts", "America/New_York").alias("utc"),
        timecal.to_local("ts", "America/New_York").alias("local"),
    )
    return shape(out, event_id="int", utc="stamp", local="stamp")


LOCAL_CLOCK_SQL = f"""
SELECT {i('event_id')} AS event_id, {stamp("timezone('UTC', timezone('America/New_York', ts))")} AS utc,
       {stamp("timezone('America/New_York', timezone('UTC', ts))")} AS local
FROM events
"""


def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    import datetime as dt

    counts = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    terms = timecal.calendar_terms("d", dt.date(1995, 1, 1), harmonics=2)
    out = counts.withColumns({
        "season": timecal.season("d"), "day_type": timecal.day_type("d", F.lit(False)),
        "year_end": timecal.year_end_flag("d").cast("int"), **dict(terms),
    })
    kinds = {name: ("int" if name.startswith("dow") else "double:6") for name, _ in terms}
    return shape(out, d="date", n_orders="int", season="text", day_type="text", year_end="int", **kinds)


_ANGLE = f"(dayofyear(d) * {2 * math.pi!r} / 365.25)"

CALENDAR_SQL = f"""
WITH c AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
SELECT {day('d')} AS d, {i('n')} AS n_orders,
       CASE WHEN month(d) IN (12, 1, 2) THEN 'winter' WHEN month(d) <= 5 THEN 'spring'
            WHEN month(d) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
       CASE isodow(d) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END AS day_type,
       {i("((month(d) = 12 AND day(d) >= 24) OR (month(d) = 1 AND day(d) = 1))")} AS year_end,
       {", ".join(f"{i(f'isodow(d) = {k + 1}')} AS dow_{k}" for k in range(1, 7))},
       {r("date_diff('day', DATE '1995-01-01', d) / 365.25", 6)} AS trend,
       {", ".join(f"{r(f'{f}({k} * {_ANGLE})', 6)} AS {f}_{k}" for k in (1, 2) for f in ("sin", "cos"))}
FROM c
"""


def holiday_day_type(spark: SparkSession, sf: str) -> DataFrame:
    """Two holiday calendars derived from the order dates; nations 0..4 keep the northern one."""
    dates = order_dates(spark, sf)
    month, number = F.month("d"), F.dayofmonth("d")
    south = ((month == 1) & (number == 1)) | ((month == 12) & number.isin(25, 26)) | ((month == 5) & (number == 1))
    north = ((month == 1) & number.isin(1, 2)) | ((month == 12) & (number == 25)) | ((month == 11) & (number == 30))
    holidays = dates.select(F.col("d").alias("date"), F.explode(F.array(
        F.when(south, F.lit("south")), F.when(north, F.lit("north")))).alias("division")).dropna()
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    )
    cells = orders.groupBy(F.col("o_orderdate").cast("date").alias("d"), "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )
    flagged = cal.holiday_flags(cells, holidays, day="d", flags={"is_south": "south", "is_north": "north"})
    local = cal.unit_holiday(F.col("c_nationkey"), {k: F.col("is_north") for k in range(5)}, F.col("is_south"))
    labelled = cal.label_days(flagged.withColumn("is_local", local), day="d", is_holiday="is_local")
    out = labelled.groupBy("season", "day_type", "is_christmas_period", "is_holiday_any").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.count_distinct("d").alias("n_days")
    )
    return shape(out, season="text", day_type="text", is_christmas_period="int", is_holiday_any="int", n="int",
                 total="double:2", n_days="int")


HOLIDAY_SQL = f"""
WITH {_DATES_SQL},
fl AS (SELECT d, ((month(d) = 1 AND day(d) = 1) OR (month(d) = 12 AND day(d) IN (25, 26)) OR (month(d) = 5 AND day(d) = 1)) AS s,
              ((month(d) = 1 AND day(d) IN (1, 2)) OR (month(d) = 12 AND day(d) = 25) OR (month(d) = 11 AND day(d) = 30)) AS n
       FROM dates),
cells AS (SELECT CAST(o_orderdate AS DATE) AS d, c_nationkey, count(*) AS n, sum(o_totalprice) AS total
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
lab AS (SELECT cells.*, fl.s OR fl.n AS any_h, CASE WHEN c_nationkey < 5 THEN fl.n ELSE fl.s END AS h
        FROM cells JOIN fl ON cells.d = fl.d)
SELECT CASE WHEN month(d) IN (12, 1, 2) THEN 'winter' WHEN month(d) <= 5 THEN 'spring'
            WHEN month(d) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
       CASE WHEN h THEN 'holiday' WHEN isodow(d) = 6 THEN 'saturday' WHEN isodow(d) = 7 THEN 'sunday' ELSE 'weekday' END AS day_type,
       {i("((month(d) = 12 AND day(d) >= 24) OR (month(d) = 1 AND day(d) = 1))")} AS is_christmas_period,
       {i('any_h')} AS is_holiday_any, {i('sum(n)')} AS n, {r('sum(total)', 2)} AS total, {i('count(DISTINCT d)')} AS n_days
FROM lab GROUP BY 1, 2, 3, 4
"""


def multi_format_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written three ways by order status, parsed back; priorities coerced to numbers."""
    orders = table(spark, sf, "orders")
    written = (
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd-MMM-yyyy"))
        .otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "dd-MMM-yy")))
    )
    parsed = orders.select(
        "o_orderstatus", parsing.parse_date(written).alias("d"),
        parsing.number("o_orderpriority").alias("bad"), parsing.number(F.substring("o_orderpriority", 1, 1)).alias("rank"),
    )
    out = parsed.groupBy("o_orderstatus", "d").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_numeric"), F.sum("rank").alias("rank_sum")
    )
    return shape(out, o_orderstatus="text", d="date", n="int", n_numeric="int", rank_sum="double:2")


FORMATS_SQL = f"""
WITH w AS (SELECT o_orderstatus, o_orderpriority,
  CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'F' THEN strftime(o_orderdate, '%d-%b-%Y')
       ELSE strftime(o_orderdate, '%d-%b-%y') END AS t FROM orders),
p AS (SELECT o_orderstatus, o_orderpriority, CAST(CASE length(t) WHEN 10 THEN try_strptime(t, '%Y-%m-%d')
             WHEN 11 THEN try_strptime(t, '%d-%b-%Y') ELSE try_strptime(t, '%d-%b-%y') END AS DATE) AS d FROM w)
SELECT o_orderstatus, {day('d')} AS d, {i('count(*)')} AS n, {i('count(TRY_CAST(o_orderpriority AS DOUBLE))')} AS n_numeric,
       {r('sum(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE))', 2)} AS rank_sum
FROM p GROUP BY 1, 2
"""

QUERIES = [
    Query("local_midnight_utc", local_midnight_utc, LOCAL_MIDNIGHT_SQL, "T1"),
    Query("periods_per_local_day", periods_per_local_day, PERIODS_SQL, "T3"),
    Query("period_end_utc", period_end_utc, PERIOD_END_SQL, "T2 B7"),
    Query("local_clock_utc", local_clock_utc, LOCAL_CLOCK_SQL, "T4 T7"),
    Query("calendar_features", calendar_features, CALENDAR_SQL, "T8 T9 T10 T12"),
    Query("holiday_day_type", holiday_day_type, HOLIDAY_SQL, "C13 T9 T11"),
    Query("multi_format_dates", multi_format_dates, FORMATS_SQL, "B1 B2"),
]
