"""Fixed effects, bootstrap, placebo, power and leave-one-out on the zone x month panel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.catalog.base import Query, ZONE_MONTHS_SQL, day, i, r, shape, zone_months
from pitpanel.functions import draws
from pitpanel.operators import features as feat
from pitpanel.operators import fixed_effects as fe
from pitpanel.operators import interaction as inter
from pitpanel.operators import simulation as sim
from pitpanel.session import cut_lineage

GROUPS = 5


def demean_two_way_balanced(spark: SparkSession, sf: str) -> DataFrame:
    out = fe.absorb(zone_months(spark, sf), ["y", "x"], unit="unit", period="month", balanced=True)
    return shape(out, unit="int", month="date", y_within="double:5", x_within="double:5")


WITHIN_SQL = f"""
{ZONE_MONTHS_SQL},
wi AS (SELECT unit, month,
       y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY month) + avg(y) OVER () AS yw,
       x - avg(x) OVER (PARTITION BY unit) - avg(x) OVER (PARTITION BY month) + avg(x) OVER () AS xw FROM zm)
"""

DEMEAN_SQL = f"""WITH {WITHIN_SQL} SELECT {i('unit')} AS unit, {day('month')} AS month, {r('yw', 5)} AS y_within,
       {r('xw', 5)} AS x_within FROM wi"""


SPARSE = 4


def _sparse(panel: DataFrame, units: int) -> DataFrame:
    """The panel in ``units`` groups of zones, of which most lack some months."""
    number = F.month("month") + 12 * F.year("month")
    return panel.filter((F.col("unit") * 5 + number) % SPARSE != 0).withColumn("unit", F.col("unit") % units)


def demean_two_way_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Means of both sets taken off a panel with gaps and repeated cells."""
    out = fe.absorb(_sparse(zone_months(spark, sf), 3), ["y", "x"], unit="unit", period="month")
    return shape(out, unit="int", month="date", y="double:3", y_within="double:5", x_within="double:5")


#: With three groups of zones two dummies are left once months are taken off, so the normal equations are two by two.
SPARSE_SQL = f"""
WITH {ZONE_MONTHS_SQL},
sp AS (SELECT unit % 3 AS unit, month, y, x FROM zm WHERE (unit * 5 + month(month) + 12 * year(month)) % {SPARSE} <> 0),
w AS (SELECT unit, month, y, y - avg(y) OVER m AS yt, x - avg(x) OVER m AS xt,
             (unit = 1)::INT - avg((unit = 1)::INT) OVER m AS a, (unit = 2)::INT - avg((unit = 2)::INT) OVER m AS b
      FROM sp WINDOW m AS (PARTITION BY month)),
s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * yt) AS ay, sum(b * yt) AS byy, sum(a * xt) AS ax, sum(b * xt) AS bx FROM w),
e AS (SELECT (bb * ay - ab * byy) / (aa * bb - ab * ab) AS ya, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS yb,
             (bb * ax - ab * bx) / (aa * bb - ab * ab) AS xa, (aa * bx - ab * ax) / (aa * bb - ab * ab) AS xb FROM s)
SELECT {i('unit')} AS unit, {day('month')} AS month, {r('y', 3)} AS y, {r('yt - ya * a - yb * b', 5)} AS y_within,
       {r('xt - xa * a - xb * b', 5)} AS x_within FROM w, e
"""


def panel_components(spark: SparkSession, sf: str) -> DataFrame:
    """Zones that share months, directly or through other zones, where odd zones have odd months only."""
    number = F.month("month") + 12 * F.year("month")
    split = zone_months(spark, sf).filter((F.col("unit") % 2 == number % 2) & ((F.col("unit") + number) % 3 != 0))
    return shape(fe.panel_components(split, unit="unit", period="month"), unit="int", component="date")


COMPONENTS_SQL = f"""
WITH RECURSIVE {ZONE_MONTHS_SQL},
c AS (SELECT DISTINCT unit, month FROM zm WHERE unit % 2 = (month(month) + 12 * year(month)) % 2 AND (unit + month(month) + 12 * year(month)) % 3 <> 0),
g AS (SELECT DISTINCT a.unit AS u, b.unit AS v FROM c a JOIN c b USING (month)),
t AS (SELECT u, v FROM g UNION SELECT t.u, g.v FROM t JOIN g ON g.u = t.v)
SELECT {i('t.u')} AS unit, {day('min(month)')} AS component FROM t JOIN c ON c.unit = t.v GROUP BY t.u
"""


def _blocks(spark: SparkSession, sf: str, *, groups: int | None = None) -> DataFrame:
    within = fe.absorb(zone_months(spark, sf), ["y", "x"], unit="unit", period="month", balanced=True)
    if groups:
        within = within.withColumn("unit", F.col("unit") % groups)
    return cut_lineage(fe.cluster_blocks(within, outcome="y_within", regressors=["x_within"], cluster="unit"))


def two_way_fe_beta(spark: SparkSession, sf: str) -> DataFrame:
    out = fe.fit_from_blocks(_blocks(spark, sf), ["x"])
    return shape(out, regressor="text", estimate="double:6", cluster_se="double:6", t_stat="double:6", n_obs="int",
                 n_clusters="int", residual_sd="double:5")


BETA_SQL = f"""
WITH {WITHIN_SQL},
b AS (SELECT sum(xw * yw) / sum(xw * xw) AS beta, sum(xw * xw) AS xx, count(*) AS n FROM wi),
s AS (SELECT unit, sum(xw * (yw - beta * xw)) AS score FROM wi, b GROUP BY unit),
v AS (SELECT sqrt(sum(score * score) / (any_value(xx) * any_value(xx)) * (count(*) / (count(*) - 1.0)) * (any_value(n) - 1.0) / (any_value(n) - 1)) AS se,
             count(*) AS g FROM s, b),
sd AS (SELECT stddev_samp(yw - beta * xw) AS sd FROM wi, b)
SELECT 'x' AS regressor, {r('beta', 6)} AS estimate, {r('se', 6)} AS cluster_se, {r('beta / se', 6)} AS t_stat, {i('n')} AS n_obs,
       {i('g')} AS n_clusters, {r('sd', 5)} AS residual_sd FROM b, v, sd
"""


def cluster_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Cross products per zone, the only thing inference keeps of the panel."""
    return shape(_blocks(spark, sf), cluster="int", n="int", xx_0_0="double:4", xy_0="double:4", yy="double:2")


CLUSTER_SQL = f"""WITH {WITHIN_SQL} SELECT {i('unit')} AS cluster, {i('count(*)')} AS n, {r('sum(xw * xw)')} AS xx_0_0,
       {r('sum(xw * yw)')} AS xy_0, {r('sum(yw * yw)', 2)} AS yy FROM wi GROUP BY unit"""


def sensitivity_one_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Slopes with one set of effects dropped, and with none."""
    panel = zone_months(spark, sf)
    rows = None
    for label, unit_effects, period_effects in (("unit", True, False), ("period", False, True), ("none", False, False)):
        within = fe.absorb(panel, ["y", "x"], unit="unit", period="month", unit_effects=unit_effects,
                           period_effects=period_effects)
        one = within.agg((F.sum(F.col("x_within") * F.col("y_within")) / F.sum(F.col("x_within") * F.col("x_within"))).alias("estimate"))
        one = one.select(F.lit(label).alias("effects"), "estimate")
        rows = one if rows is None else rows.unionByName(one)
    return shape(rows, effects="text", estimate="double:6")


SENSITIVITY_SQL = f"""
WITH {ZONE_MONTHS_SQL},
w AS (SELECT y - avg(y) OVER (PARTITION BY unit) AS yu, x - avg(x) OVER (PARTITION BY unit) AS xu,
             y - avg(y) OVER (PARTITION BY month) AS ym, x - avg(x) OVER (PARTITION BY month) AS xm, x, y FROM zm)
SELECT 'unit' AS effects, {r('sum(xu * yu) / sum(xu * xu)', 6)} AS estimate FROM w
UNION ALL SELECT 'period', {r('sum(xm * ym) / sum(xm * xm)', 6)} FROM w
UNION ALL SELECT 'none', {r('sum(x * y) / sum(x * x)', 6)} FROM w
"""


def wild_bootstrap_enumerated(spark: SparkSession, sf: str) -> DataFrame:
    """All sign vectors of five clusters: the exact restricted bootstrap distribution."""
    out = fe.bootstrap_t(_blocks(spark, sf, groups=GROUPS), 1, seed=None)
    return shape(out, draw="int", t_star="double:6")


BOOTSTRAP_SQL = f"""
WITH {WITHIN_SQL},
blk AS (SELECT unit % {GROUPS} AS g, sum(xw * xw) AS a, sum(xw * yw) AS s FROM wi GROUP BY 1),
tot AS (SELECT sum(a) AS xx FROM blk),
dr AS (SELECT d, g, a, s, CASE WHEN (d // CAST(pow(2, g) AS BIGINT)) % 2 = 1 THEN 1.0 ELSE -1.0 END AS w
       FROM blk, (SELECT unnest(range({2 ** GROUPS})) AS d)),
be AS (SELECT d, sum(w * s) / any_value(xx) AS b FROM dr, tot GROUP BY d),
va AS (SELECT dr.d, any_value(b) AS b, sum(pow(w * s - a * b, 2)) / pow(any_value(xx), 2) AS v FROM dr JOIN be USING (d), tot GROUP BY dr.d)
SELECT {i('d')} AS draw, {r('b / sqrt(v)', 6)} AS t_star FROM va
"""


def interaction_products(spark: SparkSession, sf: str) -> DataFrame:
    """Zone features from the panel, standardised, times cold severity over the whole panel."""
    panel = zone_months(spark, sf).withColumnRenamed("x", "weather")
    raw = panel.groupBy("unit").agg(F.avg("weather").alias("level"), F.stddev_pop("weather").alias("spread"),
                                    F.count(F.lit(1)).alias("n")).withColumn("covered", F.col("unit") != 12)
    features = feat.standardise(raw, ["level", "spread"], covered="covered").select("unit", "level_z", "spread_z")
    out = inter.interaction_panel(panel.withColumn("forecast", F.lit(1000.0)), features, unit="unit", forecast="forecast",
                                  outcome="y", severity_source="weather", names=["level", "spread"])
    return shape(out, unit="int", month="date", forecast_error="double:4", cold_severity_z="double:6",
                 level_x_severity="double:5", spread_x_severity="double:5")


INTERACTION_SQL = f"""
WITH {ZONE_MONTHS_SQL},
f AS (SELECT unit, avg(x) AS level, stddev_pop(x) AS spread, unit <> 12 AS covered FROM zm GROUP BY unit),
z AS (SELECT unit, CASE WHEN covered THEN (level - avg(level) FILTER (covered) OVER ()) / stddev_pop(level) FILTER (covered) OVER () END AS lz,
             CASE WHEN covered THEN (spread - avg(spread) FILTER (covered) OVER ()) / stddev_pop(spread) FILTER (covered) OVER () END AS sz FROM f),
s AS (SELECT unit, month, 1000.0 - y AS e, (-x - avg(-x) OVER ()) / stddev_pop(-x) OVER () AS c FROM zm)
SELECT {i('s.unit')} AS unit, {day('month')} AS month, {r('e')} AS forecast_error, {r('c', 6)} AS cold_severity_z,
       {r('lz * c', 5)} AS level_x_severity, {r('sz * c', 5)} AS spread_x_severity
FROM s JOIN z USING (unit)
"""


def leave_one_unit_out(spark: SparkSession, sf: str) -> DataFrame:
    out = sim.leave_one_unit_out(zone_months(spark, sf), outcome="y", regressor="x", unit="unit", period="month", balanced=True)
    return shape(out, left_out="int", estimate="double:6")


LEAVE_OUT_SQL = f"""
WITH {ZONE_MONTHS_SQL},
k AS (SELECT o.unit AS left_out, zm.* FROM zm JOIN (SELECT DISTINCT unit FROM zm) o ON o.unit <> zm.unit),
w AS (SELECT left_out,
      y - avg(y) OVER (PARTITION BY left_out, unit) - avg(y) OVER (PARTITION BY left_out, month) + avg(y) OVER (PARTITION BY left_out) AS yw,
      x - avg(x) OVER (PARTITION BY left_out, unit) - avg(x) OVER (PARTITION BY left_out, month) + avg(x) OVER (PARTITION BY left_out) AS xw FROM k)
SELECT {i('left_out')} AS left_out, {r('sum(xw * yw) / sum(xw * xw)', 6)} AS estimate FROM w GROUP BY 1
"""


def _signs_sql(seed: int, draw: str, *texts: str) -> str:
    """SQL: the sign of a draw, a bit of the md5 of its keys."""
    digit = f"substr(md5(concat_ws(':', {seed}, {draw} // 128, {', '.join(texts)})), CAST({draw} % 128 // 4 + 1 AS INT), 1)"
    return f"(CASE WHEN ((instr('0123456789abcdef', {digit}) - 1) // CAST(pow(2, 3 - {draw} % 4) AS BIGINT)) % 2 = 1 THEN 1.0 ELSE -1.0 END)"


def _uniform_sql(seed: int, *texts: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(texts)})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _normal_sql(seed: int, *texts: str) -> str:
    return (f"(sqrt(-2.0 * ln({_uniform_sql(seed, '1', *texts)})) * cos({2.0 * math.pi!r} * {_uniform_sql(seed, '2', *texts)}))")


def _tests_sql(blocks: str, keys: tuple[str, ...], n_draws: int, seed: int) -> str:
    """SQL tables ``ft`` (keys, beta, se, g) and ``pv`` (keys, n_draws, p) of a test with one regressor.

    ``blocks`` has (keys, cluster, n, xx, xy) a row for each cluster.
    """
    by, on = "".join(f"{k}, " for k in keys), " AND ".join([f"a.{k} = b.{k}" for k in keys]) or "true"
    own = "".join(f"a.{k}, " for k in keys)
    group = f"GROUP BY {', '.join(f'a.{k}' for k in keys)}" if keys else ""
    sign = _signs_sql(seed, "draw", "cluster", "0", *keys)
    return f"""
tot AS (SELECT {by}sum(xx) AS sxx, sum(xy) / sum(xx) AS beta, sum(n) AS n, count(*) AS g FROM {blocks} {group.replace('a.', '')}),
ft AS (SELECT {own}any_value(beta) AS beta, any_value(b.n) AS n_obs, any_value(g) AS g,
              sqrt(sum(pow(xy - xx * beta, 2))) / any_value(sxx) * sqrt(any_value(g) / (any_value(g) - 1.0)) AS se
       FROM {blocks} a JOIN tot b ON {on} {group}),
dr AS (SELECT {by}draw, cluster, xx, xy * {sign} AS wxy FROM {blocks}, (SELECT unnest(range({n_draws})) AS draw)),
bs AS (SELECT {own}draw, sum(wxy) / any_value(sxx) AS bstar FROM dr a JOIN tot b ON {on} GROUP BY {own}draw),
ts AS (SELECT {own}a.draw, any_value(bstar) / (sqrt(sum(pow(wxy - xx * bstar, 2))) / any_value(sxx)) AS t_star
       FROM dr a JOIN bs b ON {on} AND a.draw = b.draw JOIN tot c ON {on.replace('b.', 'c.')} {'GROUP BY ' + own + 'a.draw'}, sxx),
pv AS (SELECT {own}count(t_star) AS n_draws, (count(*) FILTER (abs(t_star) >= abs(beta / se)) + 1.0) / (count(t_star) + 1.0) AS p
       FROM ts a JOIN ft b ON {on} {group})"""


def two_way_interaction_test(spark: SparkSession, sf: str) -> DataFrame:
    """The whole test with random signs."""
    out = fe.infer(_blocks(spark, sf), ["x"], bootstrap_draws=999)
    return shape(out, regressor="text", estimate="double:6", cluster_se="double:6", wild_p_value="double:4", n_draws="int")


INTERACTION_TEST_SQL = f"""
WITH {WITHIN_SQL}, bk AS (SELECT unit AS cluster, count(*) AS n, sum(xw * xw) AS xx, sum(xw * yw) AS xy FROM wi GROUP BY unit),
{_tests_sql('bk', (), 999, draws.SEED)}
SELECT 'x' AS regressor, {r('beta', 6)} AS estimate, {r('se', 6)} AS cluster_se, {r('p')} AS wild_p_value, {i('n_draws')} AS n_draws FROM ft, pv
"""


def wild_bootstrap_two_regressors(spark: SparkSession, sf: str) -> DataFrame:
    """Two slopes, the second for winter months alone, each tested with the other one kept under the null."""
    panel = zone_months(spark, sf).withColumn("w", F.when(F.month("month").isin(11, 12, 1, 2, 3), F.col("x")).otherwise(0.0))
    out = fe.two_way_regression(panel, outcome="y", regressors=["x", "w"], unit="unit", period="month", balanced=True)
    return shape(out, regressor="text", estimate="double:6", cluster_se="double:6", wild_p_value="double:4", n_draws="int")


TWO_SLOPES_SQL = f"""
WITH {ZONE_MONTHS_SQL},
pn AS (SELECT unit, month, y, x, CASE WHEN month(month) IN (11, 12, 1, 2, 3) THEN x ELSE 0.0 END AS w FROM zm),
wi AS (SELECT unit, {', '.join(f"{c} - avg({c}) OVER (PARTITION BY unit) - avg({c}) OVER (PARTITION BY month) + avg({c}) OVER () AS {c}" for c in "yxw")} FROM pn),
bk AS (SELECT unit AS cluster, count(*) AS n, sum(x * x) AS a00, sum(x * w) AS a01, sum(w * w) AS a11, sum(x * y) AS s0, sum(w * y) AS s1 FROM wi GROUP BY unit),
tt AS (SELECT sum(a00) AS t00, sum(a01) AS t01, sum(a11) AS t11, sum(s0) AS t0, sum(s1) AS t1, sum(n) AS nn, count(*) AS g FROM bk),
iv AS (SELECT *, t11 / (t00 * t11 - t01 * t01) AS i00, -t01 / (t00 * t11 - t01 * t01) AS i01, t00 / (t00 * t11 - t01 * t01) AS i11 FROM tt),
so AS (SELECT 0 AS target, i00 AS c0, i01 AS c1, 0.0 AS n0, t1 / t11 AS n1, i00 * t0 + i01 * t1 AS b0, i01 * t0 + i11 * t1 AS b1, * FROM iv
       UNION ALL SELECT 1, i01, i11, t0 / t00, 0.0, i00 * t0 + i01 * t1, i01 * t0 + i11 * t1, * FROM iv),
ft AS (SELECT target, any_value(CASE target WHEN 0 THEN b0 ELSE b1 END) AS beta,
              sqrt(sum(pow(c0 * (s0 - a00 * b0 - a01 * b1) + c1 * (s1 - a01 * b0 - a11 * b1), 2)) * any_value(g / (g - 1.0) * (nn - 1.0) / (nn - 2.0))) AS se
       FROM bk, so GROUP BY target),
dr AS (SELECT target, draw, cluster, a00, a01, a11, a00 * n0 + a01 * n1 AS f0, a01 * n0 + a11 * n1 AS f1,
              {_signs_sql(draws.SEED, 'draw', 'cluster', 'target')} AS sg, s0, s1, c0, c1, i00, i01, i11
       FROM bk, so, (SELECT unnest(range(999)) AS draw)),
st AS (SELECT *, f0 + sg * (s0 - f0) AS m0, f1 + sg * (s1 - f1) AS m1 FROM dr),
bs AS (SELECT target, draw, any_value(i00) * sum(m0) + any_value(i01) * sum(m1) AS e0, any_value(i01) * sum(m0) + any_value(i11) * sum(m1) AS e1
       FROM st GROUP BY target, draw),
ts AS (SELECT target, draw, any_value(CASE target WHEN 0 THEN e0 ELSE e1 END)
              / sqrt(sum(pow(c0 * (m0 - a00 * e0 - a01 * e1) + c1 * (m1 - a01 * e0 - a11 * e1), 2))) AS t_star
       FROM st JOIN bs USING (target, draw) GROUP BY target, draw),
pv AS (SELECT target, count(*) AS n_draws, (count(*) FILTER (abs(t_star) >= abs(beta / se)) + 1.0) / (count(*) + 1.0) AS p
       FROM ts JOIN ft USING (target) GROUP BY target)
SELECT CASE target WHEN 0 THEN 'x' ELSE 'w' END AS regressor, {r('beta', 6)} AS estimate, {r('se', 6)} AS cluster_se,
       {r('p')} AS wild_p_value, {i('n_draws')} AS n_draws FROM ft JOIN pv USING (target)
"""


def placebo_runs(spark: SparkSession, sf: str) -> DataFrame:
    panel = zone_months(spark, sf).withColumn("severity", F.col("x"))
    out = sim.placebo(panel, outcome="y", severity="severity", unit="unit", period="month", mde=10.0, replications=50,
                      bootstrap_draws=99, balanced=True)
    return shape(out, replication="int", estimate="double:6", wild_p_value="double:4", abs_estimate_over_mde="double:6",
                 n_clusters="int")


PLACEBO_SQL = f"""
WITH {ZONE_MONTHS_SQL},
rw AS (SELECT rep, unit, {_normal_sql(draws.SEED, 'rep', 'unit')} AS z FROM (SELECT unnest(range(50)) AS rep), (SELECT DISTINCT unit FROM zm)),
sc AS (SELECT rep, unit, (z - avg(z) OVER (PARTITION BY rep)) / stddev_pop(z) OVER (PARTITION BY rep) AS score FROM rw),
pn AS (SELECT rep, unit, month, y, score * x AS x FROM zm JOIN sc USING (unit)),
wi AS (SELECT rep, unit,
       y - avg(y) OVER (PARTITION BY rep, unit) - avg(y) OVER (PARTITION BY rep, month) + avg(y) OVER (PARTITION BY rep) AS yw,
       x - avg(x) OVER (PARTITION BY rep, unit) - avg(x) OVER (PARTITION BY rep, month) + avg(x) OVER (PARTITION BY rep) AS xw FROM pn),
bk AS (SELECT rep, unit AS cluster, count(*) AS n, sum(xw * xw) AS xx, sum(xw * yw) AS xy FROM wi GROUP BY rep, unit),
{_tests_sql('bk', ('rep',), 99, draws.SEED + 1)}
SELECT {i('rep')} AS replication, {r('beta', 6)} AS estimate, {r('p')} AS wild_p_value, {r('abs(beta) / 10.0', 6)} AS abs_estimate_over_mde,
       {i('g')} AS n_clusters FROM ft JOIN pv USING (rep)
"""


POWER = {"simulations": 40, "bootstrap_draws": 99}


def _power(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return sim.power_curve(zone_months(spark, sf), outcome="y", unit="unit", period="month", severity="x", balanced=True, **POWER)


def power_curve(spark: SparkSession, sf: str) -> DataFrame:
    return shape(_power(spark, sf)[0], effect_id="int", effect="double:4", power="double:4")


def power_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest effect found four times in five, and the facts of the panel."""
    return shape(_power(spark, sf)[1], mde="double:4", mde_share_of_mean_abs_error="double:6", size_at_zero="double:4", n_obs="int",
                 n_clusters="int", n_periods="int", residual_sd="double:4", mean_abs_error="double:4", interaction_sd="double:5")


_POWER_SQL = f"""
WITH {ZONE_MONTHS_SQL},
rw AS (SELECT unit, {_normal_sql(draws.SEED, '0', 'unit')} AS z FROM (SELECT DISTINCT unit FROM zm)),
sc AS (SELECT unit, (z - avg(z) OVER ()) / stddev_pop(z) OVER () AS score FROM rw),
pn AS (SELECT unit, month, y, score * (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x FROM zm JOIN sc USING (unit)),
ro AS (SELECT unit, month, y, x AS raw, row_number() OVER (PARTITION BY unit ORDER BY month) AS pos,
       y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY month) + avg(y) OVER () AS r,
       x - avg(x) OVER (PARTITION BY unit) - avg(x) OVER (PARTITION BY month) + avg(x) OVER () AS x FROM pn),
fa AS (SELECT stddev_samp(r) AS sd, avg(abs(y)) AS mean_abs, stddev_pop(raw) AS isd, count(*) AS n_obs, count(DISTINCT unit) AS gu,
              count(DISTINCT month) AS np FROM ro),
nu AS (SELECT unit, row_number() OVER (ORDER BY substr(md5(CAST(unit AS VARCHAR)), 1, {sim.BUCKET_DIGITS}), unit) - 1 AS id, count(*) OVER () AS g
       FROM (SELECT DISTINCT unit FROM zm)),
ch AS (SELECT simulation, unit, least(CAST(floor({_uniform_sql(draws.SEED + 1, 'simulation', 'unit')} * g) AS BIGINT), g - 1) AS id
       FROM nu, (SELECT unnest(range({POWER['simulations']})) AS simulation)),
dn AS (SELECT simulation, ch.unit, nu.unit AS source FROM ch JOIN nu USING (id)),
tr AS (SELECT simulation, a.unit, a.month, a.x, b.r FROM ro a JOIN dn ON a.unit = dn.unit JOIN ro b ON b.unit = dn.source AND b.pos = a.pos),
wr AS (SELECT simulation, unit, x, r - avg(r) OVER (PARTITION BY simulation, unit) - avg(r) OVER (PARTITION BY simulation, month)
              + avg(r) OVER (PARTITION BY simulation) AS yw FROM tr),
cs AS (SELECT simulation, unit AS cluster, count(*) AS n, sum(x * x) AS xx, sum(x * yw) AS xy FROM wr GROUP BY simulation, unit),
ef AS (SELECT unnest(range({len(sim.EFFECT_MULTIPLES)})) AS effect_id, unnest({list(sim.EFFECT_MULTIPLES)!r}) AS m),
bk AS (SELECT effect_id, simulation, cluster, n, xx, xy + m * sd * xx AS xy FROM cs, ef, fa),
{_tests_sql('bk', ('effect_id', 'simulation'), POWER['bootstrap_draws'], draws.SEED + 2)},
pc AS (SELECT effect_id, any_value(m * sd) AS effect, avg(CASE WHEN p <= 0.05 THEN 1.0 ELSE 0.0 END) AS power
       FROM pv JOIN ef USING (effect_id), fa GROUP BY effect_id)
"""

POWER_CURVE_SQL = f"{_POWER_SQL} SELECT {i('effect_id')} AS effect_id, {r('effect')} AS effect, {r('power')} AS power FROM pc"

POWER_SUMMARY_SQL = f"""{_POWER_SQL}, md AS (SELECT min(effect) FILTER (power >= 0.8) AS mde, max(power) FILTER (effect = 0) AS size0 FROM pc)
SELECT {r('mde')} AS mde, {r('mde / mean_abs', 6)} AS mde_share_of_mean_abs_error, {r('size0')} AS size_at_zero, {i('n_obs')} AS n_obs,
       {i('gu')} AS n_clusters, {i('np')} AS n_periods, {r('sd')} AS residual_sd, {r('mean_abs')} AS mean_abs_error, {r('isd', 5)} AS interaction_sd
FROM md, fa
"""


QUERIES = [
    Query("demean_two_way_balanced", demean_two_way_balanced, DEMEAN_SQL, "E8"),
    Query("demean_two_way_sparse", demean_two_way_sparse, SPARSE_SQL, "E8"),
    Query("panel_components", panel_components, COMPONENTS_SQL, "E8"),
    Query("two_way_fe_beta", two_way_fe_beta, BETA_SQL, "P1 P2"),
    Query("cluster_scores", cluster_scores, CLUSTER_SQL, "P2"),
    Query("sensitivity_one_effect", sensitivity_one_effect, SENSITIVITY_SQL, "P1"),
    Query("wild_bootstrap_enumerated", wild_bootstrap_enumerated, BOOTSTRAP_SQL, "P3 C16"),
    Query("interaction_products", interaction_products, INTERACTION_SQL, "P4 C7 H11 H12 D5"),
    Query("leave_one_unit_out", leave_one_unit_out, LEAVE_OUT_SQL, "P9"),
    Query("two_way_interaction_test", two_way_interaction_test, INTERACTION_TEST_SQL, "P1 P3 P5"),
    Query("wild_bootstrap_two_regressors", wild_bootstrap_two_regressors, TWO_SLOPES_SQL, "P1 P3"),
    Query("placebo_runs", placebo_runs, PLACEBO_SQL, "P6 C15"),
    Query("power_curve", power_curve, POWER_CURVE_SQL, "P7 P8 C16 E9 E10"),
    Query("power_summary", power_summary, POWER_SUMMARY_SQL, "P8 F4"),
]
