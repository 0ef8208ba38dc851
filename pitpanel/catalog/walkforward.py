"""Folds, running sums and walk-forward regressions on supplier panels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.catalog.base import Query, day, i, r, shape, stamp, table
from pitpanel.functions import timecal
from pitpanel.operators import folds as fo
from pitpanel.operators import models as mo
from pitpanel.session import cut_lineage

FIRST_CUT = dt.datetime(1996, 12, 25)
PLAN = fo.FoldPlan(initial_train_end=FIRST_CUT, span_months=3, embargo=dt.timedelta(days=7))

# Candidate folds in SQL: cuts three months apart until a window opens after the last row.
FOLD_SQL = """
span AS (SELECT min({time}) AS lo, max({time}) AS hi FROM {source}),
cand AS (SELECT k, TIMESTAMP '1996-12-25' + to_months(CAST(3 * k AS INTEGER)) AS cut,
                TIMESTAMP '1996-12-25' + to_months(CAST(3 * k AS INTEGER)) + INTERVAL 7 DAY AS test_start,
                TIMESTAMP '1996-12-25' + to_months(CAST(3 * (k + 1) AS INTEGER)) + INTERVAL 7 DAY AS test_end
         FROM (SELECT unnest(range(200)) AS k), span
         WHERE TIMESTAMP '1996-12-25' + to_months(CAST(3 * k AS INTEGER)) + INTERVAL 7 DAY <= hi),
tr AS (SELECT k, count(*) AS train_rows, min({time}) AS train_start, max({time}) AS train_end
       FROM cand JOIN {source} ON {time} <= cut GROUP BY k),
te AS (SELECT k, count(*) AS test_rows FROM cand JOIN {source} ON {time} >= test_start AND {time} < test_end GROUP BY k),
folds AS (SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS fold, cand.*, train_rows, train_start, train_end, test_rows
          FROM cand JOIN tr USING (k) JOIN te USING (k))
"""


def fold_table(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    out = fo.build_folds(orders, "o_orderdate", PLAN).as_rows(spark)
    return shape(out, fold="int", train_rows="int", train_start="stamp", train_end="stamp", cut="stamp", test_start="stamp",
                 test_end="stamp", test_rows="int")


FOLD_TABLE_SQL = f"""
WITH {FOLD_SQL.format(source='orders', time='o_orderdate')}
SELECT fold, {i('train_rows')} AS train_rows, {stamp('train_start')} AS train_start, {stamp('train_end')} AS train_end,
       {stamp('cut')} AS cut, {stamp('test_start')} AS test_start, {stamp('test_end')} AS test_end, {i('test_rows')} AS test_rows
FROM folds
"""


def fold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    out = fo.assign_folds(orders, "o_orderdate", fo.build_folds(orders, "o_orderdate", PLAN))
    return shape(out.select("o_orderkey", "fold"), o_orderkey="int", fold="int")


FOLD_ASSIGNMENT_SQL = f"""
WITH {FOLD_SQL.format(source='orders', time='o_orderdate')}
SELECT {i('o_orderkey')} AS o_orderkey, fold FROM orders LEFT JOIN folds ON o_orderdate >= test_start AND o_orderdate < test_end
"""


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """(supplier, day): shipped quantity, mean gross price and mean net price.

    Folds, sums and predictions each read the panel, so it is stored once. A supplier's rows lie in one
    file, so a task that reads them sends one row of sums for each of the supplier's folds.
    """
    return cut_lineage(_shipments(spark, sf))


def _shipments(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    return lines.repartition("l_suppkey").groupBy("l_suppkey", "l_shipdate").agg(
        F.sum("l_quantity").alias("qty"), (F.avg("l_extendedprice") / 10000).alias("price"),
        (F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 10000).alias("net_price"),
    )


SHIPMENTS_SQL = """
sh AS (SELECT l_suppkey, l_shipdate, sum(l_quantity) AS qty, avg(l_extendedprice) / 10000 AS price,
              avg(l_extendedprice * (1 - l_discount)) / 10000 AS net_price FROM lineitem GROUP BY 1, 2)
"""

SIMPLE = mo.CalendarModel(target="qty", fit_on="price", serve="net_price", group=["l_suppkey"], time="l_shipdate",
                          day="l_shipdate", calendar=False, ridge=0.0, min_rows=30)


def fold_audit(spark: SparkSession, sf: str) -> DataFrame:
    panel = shipments(spark, sf)
    table_ = fo.build_folds(panel, "l_shipdate", PLAN)
    beta = mo.solve_coefficients(mo.running_sums(panel, SIMPLE, table_), SIMPLE)
    out = fo.with_fitted(table_.as_rows(spark), beta)
    return shape(out, fold="int", train_rows="int", train_end="stamp", test_rows="int", groups_fitted="int")


FOLD_AUDIT_SQL = f"""
WITH {SHIPMENTS_SQL}, {FOLD_SQL.format(source='sh', time='l_shipdate')},
g AS (SELECT fold, l_suppkey, count(*) AS n FROM folds JOIN sh ON l_shipdate <= cut GROUP BY 1, 2 HAVING count(*) >= 30),
f AS (SELECT fold, count(*) AS fitted FROM g GROUP BY 1)
SELECT fold, {i('train_rows')} AS train_rows, {stamp('train_end')} AS train_end, {i('test_rows')} AS test_rows,
       {i('coalesce(fitted, 0)')} AS groups_fitted
FROM folds LEFT JOIN f USING (fold)
"""


def running_gram(spark: SparkSession, sf: str) -> DataFrame:
    panel = shipments(spark, sf)
    sums = mo.running_sums(panel, SIMPLE, fo.build_folds(panel, "l_shipdate", PLAN))
    out = sums.select("l_suppkey", "fold", "n", F.get("gram", F.lit(1)).alias("sx"), F.get("gram", F.lit(2)).alias("sxx"),
                      F.get("moment", F.lit(0)).alias("sy"), F.get("moment", F.lit(1)).alias("sxy"))
    return shape(out, l_suppkey="int", fold="int", n="int", sx="double:4", sxx="double:4", sy="double:4", sxy="double:4")


RUNNING_GRAM_SQL = f"""
WITH {SHIPMENTS_SQL}, {FOLD_SQL.format(source='sh', time='l_shipdate')}
SELECT {i('l_suppkey')} AS l_suppkey, fold, {i('count(*)')} AS n, {r('sum(price)')} AS sx, {r('sum(price * price)')} AS sxx,
       {r('sum(qty)')} AS sy, {r('sum(price * qty)')} AS sxy
FROM folds JOIN sh ON l_shipdate <= cut GROUP BY 1, 2
"""


def walk_forward_simple_ols(spark: SparkSession, sf: str) -> DataFrame:
    """Fit quantity on gross price, serve net price; one prediction per test row."""
    panel, _, _ = mo.walk_forward(shipments(spark, sf), {"predicted": SIMPLE}, PLAN)
    return shape(panel, l_suppkey="int", l_shipdate="date", qty="double:2", predicted="double:4")


SIMPLE_OLS_SQL = f"""
WITH {SHIPMENTS_SQL}, {FOLD_SQL.format(source='sh', time='l_shipdate')},
b AS (SELECT fold, l_suppkey, regr_slope(qty, price) AS s, regr_intercept(qty, price) AS c FROM folds JOIN sh ON l_shipdate <= cut
      GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT {i('sh.l_suppkey')} AS l_suppkey, {day('l_shipdate')} AS l_shipdate, {r('qty', 2)} AS qty, {r('c + s * net_price')} AS predicted
FROM sh LEFT JOIN folds ON l_shipdate >= test_start AND l_shipdate < test_end
        LEFT JOIN b ON b.fold = folds.fold AND b.l_suppkey = sh.l_suppkey
"""


def walk_forward_full(spark: SparkSession, sf: str) -> DataFrame:
    """Headline, no waves and oracle from one pass over the panel, per supplier."""
    panel = shipments(spark, sf).withColumns({
        "is_holiday_any": (F.dayofmonth("l_shipdate") == 1) & F.month("l_shipdate").isin(1, 5),
        "is_christmas_period": timecal.year_end_flag("l_shipdate"),
    })
    base = dict(target="qty", fit_on="price", group=["l_suppkey"], time="l_shipdate", day="l_shipdate")
    specs = {
        "headline": mo.CalendarModel(**base, serve="net_price", harmonics=2),
        "no_waves": mo.CalendarModel(**base, serve="net_price", harmonics=0),
        "oracle_realised": mo.CalendarModel(**base, serve="price", harmonics=2),
    }
    out, _, _ = mo.walk_forward(panel, specs, PLAN)
    return shape(out, l_suppkey="int", l_shipdate="date", qty="double:2", headline="double:3", no_waves="double:3",
                 oracle_realised="double:3")


QUERIES = [
    Query("fold_table", fold_table, FOLD_TABLE_SQL, "W1"),
    Query("fold_assignment", fold_assignment, FOLD_ASSIGNMENT_SQL, "C14"),
    Query("fold_audit", fold_audit, FOLD_AUDIT_SQL, "W4"),
    Query("running_gram", running_gram, RUNNING_GRAM_SQL, "W2 E11"),
    Query("walk_forward_simple_ols", walk_forward_simple_ols, SIMPLE_OLS_SQL, "W2 W3 W4 W5"),
    Query("walk_forward_full", walk_forward_full, None, "W2 W3 W4 W5 W6"),
]
