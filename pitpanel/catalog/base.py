"""Shared parts of the catalogue: table access, stand-in panels, output shaping.

Outputs use BIGINT, DOUBLE (rounded) and text only, so that two engines render
equal values equally.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.session import cut_lineage

ZONES = 13

# Means of amounts in cents often end exactly half way between two rounded values,
# where the order of a sum decides; rounding a little off centre avoids that.
OFF_CENTRE = 0.137


@dataclass(frozen=True)
class Query:
    """``sql`` is None where SQL cannot express the operator; ``covers`` lists operator ids."""

    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str = ""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shape(df: DataFrame, **kinds: str) -> DataFrame:
    """Select columns by name as ``int``, ``text``, ``date``, ``stamp`` or ``double:<digits>``."""
    out: list[Column] = []
    for name, kind in kinds.items():
        c = F.col(name)
        if kind == "int":
            c = c.cast("bigint")
        elif kind == "text":
            c = c.cast("string")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "stamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        else:
            digits = int(kind.split(":")[1])
            c = F.round(c.cast("double") + F.lit(OFF_CENTRE * 10.0**-digits), digits) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def r(expr: str, digits: int = 4) -> str:
    """SQL: rounded double without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE) + {OFF_CENTRE * 10.0**-digits!r}, {digits}) + 0.0)"


def i(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


# Zone x month panel: order value by zone of the customer, dense over all months.

def order_months(orders: DataFrame) -> DataFrame:
    month = F.trunc("o_orderdate", "month").alias("month")
    return orders.groupBy((F.col("o_custkey") % ZONES).alias("unit"), month).agg(
        (F.sum("o_totalprice") / 1000.0).alias("y")
    )


def dense_months(cells: DataFrame) -> DataFrame:
    """Every unit in every month between the first and the last."""
    return (
        cells.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
        .select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
        .select("month", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ZONES - 1).cast("bigint"))).alias("unit"))
    )


def zone_months(spark: SparkSession, sf: str) -> DataFrame:
    """(unit, month, y, x): y from orders, x the mean quantity shipped by the zone's suppliers.

    Lags, means and scores read the panel many times, so its cells (a row per zone and
    month) are stored: each big table is scanned once.
    """
    y = cut_lineage(order_months(table(spark, sf, "orders")))
    lines = table(spark, sf, "lineitem")
    x = cut_lineage(lines.groupBy(
        (F.col("l_suppkey") % ZONES).alias("unit"), F.trunc("l_shipdate", "month").alias("month")
    ).agg(F.avg("l_quantity").alias("x")))
    return (
        dense_months(y)
        .join(y, ["unit", "month"], "left")
        .join(x, ["unit", "month"], "left")
        .select("unit", "month", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("x", F.lit(0.0)).alias("x"))
    )


ZONE_MONTHS_SQL = f"""
y0 AS (SELECT o_custkey % {ZONES} AS unit, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
              sum(o_totalprice) / 1000.0 AS y FROM orders GROUP BY 1, 2),
x0 AS (SELECT l_suppkey % {ZONES} AS unit, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
              avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2),
months AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM y0),
grid AS (SELECT unit, month FROM months, (SELECT unnest(range({ZONES})) AS unit)),
zm AS (SELECT grid.unit, grid.month, coalesce(y0.y, 0.0) AS y, coalesce(x0.x, 0.0) AS x
       FROM grid LEFT JOIN y0 ON grid.unit = y0.unit AND grid.month = y0.month
                 LEFT JOIN x0 ON grid.unit = x0.unit AND grid.month = x0.month)
"""
