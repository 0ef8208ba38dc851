"""Scoring, error diagnostics and serial dependence on the zone x month panel and on events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.catalog.base import Query, ZONE_MONTHS_SQL, day, i, r, shape, table, zone_months
from pitpanel.functions import timecal
from pitpanel.operators import scoring, serial
from pitpanel.operators import pointintime as pit

FORECASTS = {"incumbent": "lag1", "baseline": "lag12", "perfect": "lag2"}


def forecast_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Zone x month outcome with three persistence forecasts (1, 12 and 2 months old)."""
    panel = zone_months(spark, sf)
    base = panel.select("unit", "month", "y")
    for months, name in ((1, "lag1"), (12, "lag12"), (2, "lag2")):
        late = base.select("unit", F.add_months("month", months).alias("month"), F.col("y").alias(name))
        panel = panel.join(late, ["unit", "month"], "left")
    return panel.withColumn("season", timecal.season("month"))


FORECAST_SQL = f"""
{ZONE_MONTHS_SQL},
fp AS (SELECT zm.*, a.y AS lag1, b.y AS lag12, c.y AS lag2,
              CASE WHEN month(zm.month) IN (12, 1, 2) THEN 'winter' WHEN month(zm.month) <= 5 THEN 'spring'
                   WHEN month(zm.month) <= 8 THEN 'summer' ELSE 'autumn' END AS season
       FROM zm LEFT JOIN zm a ON a.unit = zm.unit AND a.month + INTERVAL 1 MONTH = zm.month
               LEFT JOIN zm b ON b.unit = zm.unit AND b.month + INTERVAL 12 MONTH = zm.month
               LEFT JOIN zm c ON c.unit = zm.unit AND c.month + INTERVAL 2 MONTH = zm.month),
ok AS (SELECT * FROM fp WHERE lag1 IS NOT NULL AND lag12 IS NOT NULL AND lag2 IS NOT NULL),
long AS (SELECT unit, month, season, y, 'incumbent' AS model, lag1 AS f FROM ok
         UNION ALL SELECT unit, month, season, y, 'baseline', lag12 FROM ok
         UNION ALL SELECT unit, month, season, y, 'perfect', lag2 FROM ok)
"""

_METRICS_SQL = f"""{i('count(*)')} AS n, {r('avg(abs(f - y))')} AS mae, {r('sqrt(avg((f - y) * (f - y)))')} AS rmse,
       {r('avg(f - y)')} AS bias, {r('avg(abs(f - y) / nullif(abs(y), 0)) * 100')} AS mape_pct"""

_SCORE_KINDS = {"n": "int", "mae": "double:4", "rmse": "double:4", "bias": "double:4", "mape_pct": "double:4"}


def score_overall_and_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.score(forecast_panel(spark, sf), actual="y", forecasts=FORECASTS,
                        groupings=((), ("season",), ("unit",), ("season", "unit")))
    return shape(out, grouping="text", season="text", unit="text", model="text", **_SCORE_KINDS)


SCORE_SQL = f"""
WITH {FORECAST_SQL}
SELECT CASE WHEN grouping(season) = 0 AND grouping(unit) = 0 THEN 'season,unit' WHEN grouping(season) = 0 THEN 'season'
            WHEN grouping(unit) = 0 THEN 'unit' ELSE 'all' END AS grouping,
       season, CAST(unit AS VARCHAR) AS unit, model, {_METRICS_SQL}
FROM long GROUP BY GROUPING SETS ((model), (season, model), (unit, model), (season, unit, model))
"""


def scores_with_effective_n(spark: SparkSession, sf: str) -> DataFrame:
    """Lags inside each zone's own series."""
    out = scoring.score_with_effective_n(forecast_panel(spark, sf), actual="y", forecasts=FORECASTS,
                                         groupings=((), ("unit",)), order=["month"], series=["unit"], max_lag=12)
    return shape(out, grouping="text", unit="text", model="text", n="int", mae="double:4", n_effective="double:3")


def _effective_n_ctes(source: str, keys: str, order: str, max_lag: int) -> str:
    """CTEs from ``source(keys.., x, order..)`` to ``en(keys.., n, n_effective)``."""
    on = " AND ".join(f"e.{k} = rho.{k}" for k in keys.split(", "))
    return f"""
cen AS (SELECT {keys}, {order}, x - avg(x) OVER (PARTITION BY {keys}) AS c FROM {source}),
lg AS (SELECT {keys}, c, [{", ".join(f"c * lag(c, {k}) OVER w" for k in range(1, max_lag + 1))}] AS p
       FROM cen WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
g0 AS (SELECT {keys}, count(*) AS n, sum(c * c) AS g FROM lg GROUP BY {keys}),
ex AS (SELECT {keys}, unnest(range(1, {max_lag + 1})) AS k, unnest(p) AS v FROM lg),
gk AS (SELECT {keys}, k, coalesce(sum(v), 0.0) AS v FROM ex GROUP BY {keys}, k),
rho AS (SELECT gk.*, gk.v / g0.g AS rho FROM gk JOIN g0 USING ({keys})),
cut AS (SELECT {keys}, coalesce(min(k) FILTER (rho <= 0), {max_lag + 1}) AS stop FROM rho GROUP BY {keys}),
inf AS (SELECT {keys}, 1 + 2 * coalesce(sum(rho) FILTER (k < stop), 0) AS f FROM rho JOIN cut USING ({keys}) GROUP BY {keys}),
en AS (SELECT {keys}, n, CASE WHEN n < 3 THEN greatest(n, 1) WHEN g = 0 THEN n ELSE greatest(n / f, 1) END AS n_effective
       FROM g0 JOIN inf USING ({keys}))
"""


SCORE_N_SQL = f"""
WITH {FORECAST_SQL}, src AS (SELECT unit, model, month, f - y AS x FROM long),
{_effective_n_ctes('src', 'unit, model', 'month', 12)},
byu AS (SELECT unit, model, count(*) AS n, avg(abs(f - y)) AS mae FROM long GROUP BY 1, 2),
bya AS (SELECT model, count(*) AS n, avg(abs(f - y)) AS mae FROM long GROUP BY 1)
SELECT 'unit' AS grouping, CAST(byu.unit AS VARCHAR) AS unit, byu.model AS model, {i('byu.n')} AS n, {r('mae')} AS mae,
       {r('n_effective', 3)} AS n_effective FROM byu JOIN en USING (unit, model)
UNION ALL
SELECT 'all', NULL, bya.model, {i('bya.n')}, {r('mae')}, {r('s', 3)}
FROM bya JOIN (SELECT model, sum(n_effective) AS s FROM en GROUP BY model) USING (model)
"""


def skill_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = scoring.score(forecast_panel(spark, sf), actual="y", forecasts=FORECASTS, groupings=(("season",),))
    return shape(scoring.skill_table(scores, reference="incumbent", keys=["season"]), season="text", model="text",
                 mae="double:4", skill_pct="double:4")


SKILL_SQL = f"""
WITH {FORECAST_SQL}, m AS (SELECT season, model, avg(abs(f - y)) AS mae FROM long GROUP BY 1, 2)
SELECT m.season AS season, m.model AS model, {r('m.mae')} AS mae, {r('(b.mae - m.mae) / nullif(b.mae, 0) * 100')} AS skill_pct
FROM m JOIN m b ON b.season = m.season AND b.model = 'incumbent'
"""


def gap_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.gap_decomposition(forecast_panel(spark, sf), actual="y", incumbent="lag1", baseline="lag12",
                                    perfect_input="lag2")
    return shape(out, n="int", baseline_mae="double:4", incumbent_mae="double:4", perfect_input_mae="double:4",
                 gap="double:4", input_error_cost="double:4", input_error_share="double:4", constant_bias_cost="double:4",
                 error_correlation="double:6")


GAP_SQL = f"""
WITH {FORECAST_SQL},
m AS (SELECT *, lag12 - y AS b, lag1 - y AS e, lag2 - y AS o, avg(lag12 - y) OVER () AS mb FROM ok),
s AS (SELECT count(*) AS n, avg(abs(b)) AS bm, avg(abs(e)) AS im, avg(abs(o)) AS om, avg(abs(b - mb)) AS um, corr(b, e) AS c FROM m)
SELECT {i('n')} AS n, {r('bm')} AS baseline_mae, {r('im')} AS incumbent_mae, {r('om')} AS perfect_input_mae,
       {r('bm - im')} AS gap, {r('bm - om')} AS input_error_cost, {r('(bm - om) / nullif(bm - im, 0)')} AS input_error_share,
       {r('bm - um')} AS constant_bias_cost, {r('c', 6)} AS error_correlation
FROM s
"""


def hourly_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Events with two stand-in forecasts of their value: the payload number, and a constant."""
    return table(spark, sf, "events").select(
        F.hour("ts").alias("period"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"), F.lit(50.0).alias("flat"),
    )


def error_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.mae_by(hourly_errors(spark, sf), ["period"], actual="value", forecasts={"payload": "k", "flat": "flat"})
    return shape(out, period="int", model="text", mae="double:4")


_EV_SQL = """ev AS (SELECT hour(ts) AS period, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
el AS (SELECT period, event_type, value, 'payload' AS model, k AS f FROM ev UNION ALL SELECT period, event_type, value, 'flat', 50.0 FROM ev)"""

ERROR_HOUR_SQL = f"WITH {_EV_SQL} SELECT {i('period')} AS period, model, {r('avg(abs(f - value))')} AS mae FROM el GROUP BY 1, 2"


def pivot_models(spark: SparkSession, sf: str) -> DataFrame:
    long = scoring.mae_by(hourly_errors(spark, sf), ["event_type"], actual="value", forecasts={"payload": "k", "flat": "flat"})
    out = scoring.models_as_columns(long, by=["event_type"], models=["payload", "flat"])
    return shape(out, event_type="text", payload="double:4", flat="double:4")


PIVOT_SQL = f"""WITH {_EV_SQL} SELECT event_type, {r("avg(abs(f - value)) FILTER (model = 'payload')")} AS payload,
       {r("avg(abs(f - value)) FILTER (model = 'flat')")} AS flat FROM el GROUP BY 1"""


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    """One row per day: mean order value against 250 thousand, and the day's mean shipped quantity."""
    errors = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("day"), (F.lit(250.0) - F.col("o_totalprice") / 1000).alias("e")
    ).groupBy("day").agg(F.avg("e").alias("mean_error"))
    weather = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(
        F.avg("l_quantity").alias("covariate")
    )
    return errors.join(weather, "day")


DAILY_SQL = """
de AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(250.0 - o_totalprice / 1000) AS e FROM orders GROUP BY 1),
dw AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS w FROM lineitem GROUP BY 1),
dd AS (SELECT day, e, w FROM de JOIN dw USING (day))
"""


def daily_error(spark: SparkSession, sf: str) -> DataFrame:
    """Per day: mean error and the covariate at the day's first event."""
    events = table(spark, sf, "events").select(
        F.col("ts").cast("date").alias("day"), "ts", "value",
        (F.get_json_object("props", "$.k").cast("double") - F.col("value")).alias("e"),
    )
    out = scoring.daily_error(events, day="day", error_column="e", covariate="value", covariate_by="first", instant="ts")
    return shape(out, day="date", mean_error="double:4", covariate="double:4")


DAILY_ERROR_SQL = f"""
SELECT {day('CAST(ts AS DATE)')} AS day, {r("avg(CAST(json_extract_string(props, '$.k') AS DOUBLE) - value)")} AS mean_error,
       {r('arg_min(value, ts)')} AS covariate FROM events GROUP BY 1
"""


def cold_decile(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.low_tail_block(daily_orders(spark, sf), value="covariate", error_column="mean_error")
    return shape(out, n_days="int", mae="double:4", mean_error="double:4", all_days_mae="double:4")


COLD_SQL = f"""
WITH {DAILY_SQL}, q AS (SELECT *, (SELECT quantile_cont(w, 0.1) FROM dd) AS c FROM dd)
SELECT {i('count(*) FILTER (w <= c)')} AS n_days, {r('avg(abs(e)) FILTER (w <= c)')} AS mae,
       {r('avg(e) FILTER (w <= c)')} AS mean_error, {r('avg(abs(e))')} AS all_days_mae FROM q
"""


def decile_mae(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.mae_by_bin(daily_orders(spark, sf), value="covariate", error_column="mean_error")
    return shape(out, bin="int", n_days="int", mae="double:4")


DECILE_SQL = f"""
WITH {DAILY_SQL}, q AS (SELECT quantile_cont(w, [{", ".join(str(k / 10) for k in range(1, 10))}]) AS edges FROM dd),
b AS (SELECT e, len([x for x in edges if w > x]) AS bin FROM dd, q)
SELECT {i('bin')} AS bin, {i('count(*)')} AS n_days, {r('avg(abs(e))')} AS mae FROM b GROUP BY 1
"""


def error_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Two errors with each other and with the covariate, and how many days and zones took part."""
    panel = forecast_panel(spark, sf).dropna(subset=list(FORECASTS.values()))
    a, b = scoring.error("lag12", "y"), scoring.error("lag1", "y")
    out = panel.agg(
        F.corr(a, b).alias("errors"), F.corr(b, F.col("x")).alias("error_covariate"), F.corr("lag1", "y").alias("forecast_actual"),
        F.count_distinct("month").alias("n_months"), F.count_distinct("unit").alias("n_units"),
    )
    return shape(out, errors="double:6", error_covariate="double:6", forecast_actual="double:6", n_months="int", n_units="int")


CORR_SQL = f"""
WITH {FORECAST_SQL} SELECT {r('corr(lag12 - y, lag1 - y)', 6)} AS errors, {r('corr(lag1 - y, x)', 6)} AS error_covariate,
       {r('corr(lag1, y)', 6)} AS forecast_actual, {i('count(DISTINCT month)')} AS n_months, {i('count(DISTINCT unit)')} AS n_units
FROM ok
"""


def reconcile_sources(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    both = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left")
    out = scoring.reconcile(both, a="o_totalprice", b="net", unit=50000.0)
    return shape(out, n="int", mean_difference="double:2", mean_abs_difference="double:2", share_within_unit="double:6",
                 max_abs_difference="double:2")


RECONCILE_SQL = f"""
WITH l AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY 1),
j AS (SELECT o_totalprice - net AS d FROM orders JOIN l ON o_orderkey = k)
SELECT {i('count(*)')} AS n, {r('avg(d)', 2)} AS mean_difference, {r('avg(abs(d))', 2)} AS mean_abs_difference,
       {r('avg(CAST(abs(d) <= 50000 AS DOUBLE))', 6)} AS share_within_unit, {r('max(abs(d))', 2)} AS max_abs_difference FROM j
"""


def long_window(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.long_window(forecast_panel(spark, sf), actual="y", forecast="lag1", day="month")
    return shape(out, **_SCORE_KINDS, first_day="date", last_day="date")


LONG_SQL = f"""
WITH {FORECAST_SQL}, w AS (SELECT month, y, lag1 AS f FROM fp WHERE lag1 IS NOT NULL)
SELECT {_METRICS_SQL}, {day('min(month)')} AS first_day, {day('max(month)')} AS last_day FROM w
"""


def compare_on_common_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.compare_on_common_rows(forecast_panel(spark, sf), actual="y", forecasts=FORECASTS, day="month")
    return shape(out, n="int", window_start="date", incumbent_mae="double:4", baseline_mae="double:4", perfect_mae="double:4")


COMMON_SQL = f"""
WITH {FORECAST_SQL} SELECT {i('count(*)')} AS n, {day('min(month)')} AS window_start, {r('avg(abs(lag1 - y))')} AS incumbent_mae,
       {r('avg(abs(lag12 - y))')} AS baseline_mae, {r('avg(abs(lag2 - y))')} AS perfect_mae FROM ok
"""


def mean_levels(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.mean_level(table(spark, sf, "lineitem"), by="l_suppkey", value="l_extendedprice", factor=0.9)
    return shape(out, l_suppkey="int", mean_level="double:4", mean_level_display="double:4")


MEAN_SQL = f"""SELECT {i('l_suppkey')} AS l_suppkey, {r('avg(l_extendedprice)')} AS mean_level,
       {r('avg(l_extendedprice) * 0.9')} AS mean_level_display FROM lineitem GROUP BY 1"""


def autocorr_effective_n(spark: SparkSession, sf: str) -> DataFrame:
    """Event values smoothed by the running hour as a dependent series, per event type, 48 lags."""
    events = table(spark, sf, "events").select(
        "event_type", "ts", "event_id", (F.col("value") / 100 + F.hour("ts") * F.hour("ts") / 40).alias("x"))
    out = serial.effective_sample_size(events, value="x", order=["ts", "event_id"], group=["event_type"])
    return shape(out, event_type="text", n="int", n_effective="double:3")


AUTOCORR_SQL = f"""
WITH src AS (SELECT event_type, ts, event_id, value / 100 + hour(ts) * hour(ts) / 40 AS x FROM events),
{_effective_n_ctes('src', 'event_type', 'ts, event_id', 48)}
SELECT event_type, {i('n')} AS n, {r('n_effective', 3)} AS n_effective FROM en
"""


def diebold_mariano(spark: SparkSession, sf: str) -> DataFrame:
    """Month-old against year-old forecasts, per zone, 12 lags."""
    panel = forecast_panel(spark, sf)
    out = serial.diebold_mariano(panel, error_a=scoring.error("lag12", "y") / 1000, error_b=scoring.error("lag1", "y") / 1000,
                                 order=["month"], group=["unit"], max_lag=12, with_p_value=False)
    return shape(out, unit="int", n="int", mean_loss_differential="double:5", statistic="double:5")


_DM_LAGS = 12

DM_SQL = f"""
WITH {FORECAST_SQL},
d AS (SELECT unit, month, pow(abs(lag12 - y) / 1000, 2) - pow(abs(lag1 - y) / 1000, 2) AS x FROM ok),
c AS (SELECT unit, month, x, x - avg(x) OVER (PARTITION BY unit) AS c FROM d),
l AS (SELECT unit, x, c, {", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, _DM_LAGS + 1))}
      FROM c WINDOW w AS (PARTITION BY unit ORDER BY month)),
s AS (SELECT unit, count(*) AS n, avg(x) AS m,
             (sum(c * c) + {" + ".join(f"2 * (1 - {k} / {_DM_LAGS + 1}.0) * coalesce(sum(c * c{k}), 0)" for k in range(1, _DM_LAGS + 1))}) / count(*) AS v
      FROM l GROUP BY unit)
SELECT {i('unit')} AS unit, {i('n')} AS n, {r('m', 5)} AS mean_loss_differential,
       {r('CASE WHEN v > 0 AND n >= 10 THEN m / sqrt(v / n) END', 5)} AS statistic FROM s
"""

QUERIES = [
    Query("score_overall_and_groups", score_overall_and_groups, SCORE_SQL, "B5 B12 D6 D7 D8"),
    Query("scores_with_effective_n", scores_with_effective_n, SCORE_N_SQL, "D7 E5"),
    Query("skill_scores", skill_scores, SKILL_SQL, "D9"),
    Query("gap_decomposition", gap_decomposition, GAP_SQL, "D17 D14"),
    Query("error_by_hour", error_by_hour, ERROR_HOUR_SQL, "D10"),
    Query("pivot_models", pivot_models, PIVOT_SQL, "D24"),
    Query("daily_error", daily_error, DAILY_ERROR_SQL, "D11"),
    Query("cold_decile", cold_decile, COLD_SQL, "D13"),
    Query("decile_mae", decile_mae, DECILE_SQL, "D12 E7"),
    Query("error_correlations", error_correlations, CORR_SQL, "D14 D25"),
    Query("reconcile_sources", reconcile_sources, RECONCILE_SQL, "D15 C1"),
    Query("long_window", long_window, LONG_SQL, "D18"),
    Query("compare_on_common_rows", compare_on_common_rows, COMMON_SQL, "D19"),
    Query("mean_levels", mean_levels, MEAN_SQL, "D20"),
    Query("autocorr_effective_n", autocorr_effective_n, AUTOCORR_SQL, "E5"),
    Query("diebold_mariano", diebold_mariano, DM_SQL, "E6"),
]
