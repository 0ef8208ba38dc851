import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.functions import draws
from pitpanel.operators import fixed_effects as fe
from pitpanel.operators import interaction as inter
from pitpanel.operators import simulation as sim
from pitpanel.operators.guards import DataGuardError


def panel(units=13, periods=60, beta=0.35, seed=0, noise=1.0):
    rng = np.random.default_rng(seed)
    u, t = np.repeat(np.arange(units), periods), np.tile(np.arange(periods), units)
    stock, severity = rng.normal(size=units)[u], rng.normal(size=units * periods)
    x, x2 = stock * severity, rng.normal(size=units * periods)
    y = rng.normal(size=units)[u] + rng.normal(size=periods)[t] + beta * x + noise * rng.normal(size=units * periods)
    return pd.DataFrame({"unit": [f"z{k:02d}" for k in u], "t": t, "x": x, "x2": x2, "severity": severity, "y": y})


def demean(v, u, t):
    r = v.astype(float)
    for _ in range(500):
        p = r
        r = r - pd.Series(r).groupby(u).transform("mean").to_numpy()
        r = r - pd.Series(r).groupby(t).transform("mean").to_numpy()
        if np.abs(r - p).max() < 1e-12:
            break
    return r


def plain_fit(d, names):
    x = np.column_stack([demean(d[n].to_numpy(), d.unit.to_numpy(), d.t.to_numpy()) for n in names])
    y = demean(d.y.to_numpy(), d.unit.to_numpy(), d.t.to_numpy())
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    res, meat = y - x @ beta, np.zeros((len(names),) * 2)
    for g in d.unit.unique():
        s = x[(d.unit == g)].T @ res[(d.unit == g)]
        meat += np.outer(s, s)
    n, k, g = len(d), len(names), d.unit.nunique()
    v = inverse @ meat @ inverse * (g / (g - 1)) * ((n - 1) / (n - k))
    return x, y, inverse, beta, np.sqrt(np.diag(v)), res


def plain_enumerated(d, names, target):
    """t* for every sign vector by rebuilding the outcome."""
    x, y, inverse, *_ = plain_fit(d, names)
    keep = [j for j in range(len(names)) if j != target]
    null = np.zeros(len(names))
    if keep:
        null[keep] = np.linalg.pinv(x[:, keep].T @ x[:, keep]) @ x[:, keep].T @ y
    fit = x @ null
    codes = pd.factorize(d.unit, sort=True)[0]
    size, out = codes.max() + 1, []
    for draw in range(2**size):
        w = np.array([1.0 if draw >> b & 1 else -1.0 for b in range(size)])
        star = fit + (y - fit) * w[codes]
        b = inverse @ x.T @ star
        res, meat = star - x @ b, 0
        for g in range(size):
            s = x[codes == g].T @ res[codes == g]
            meat = meat + np.outer(s, s)
        out.append(b[target] / np.sqrt((inverse @ meat @ inverse)[target, target]))
    return np.array(out)


@pytest.mark.parametrize("frac", [1.0, 0.7])
def test_estimates_match_direct_computation(spark, frac):
    d = panel(beta=0.35).sample(frac=frac, random_state=2)
    rows = fe.two_way_regression(spark.createDataFrame(d), outcome="y", regressors=["x", "x2"], unit="unit", period="t",
                                 bootstrap_draws=99).collect()
    _, _, _, beta, se, res = plain_fit(d, ["x", "x2"])
    got = {r["regressor"]: r for r in rows}
    for j, name in enumerate(["x", "x2"]):
        assert got[name]["estimate"] == pytest.approx(beta[j], rel=1e-6)
        assert got[name]["cluster_se"] == pytest.approx(se[j], rel=1e-6)
    assert got["x"]["residual_sd"] == pytest.approx(res.std(ddof=1), rel=1e-8)
    assert got["x"]["wild_p_value"] < 0.05 < got["x2"]["wild_p_value"]
    assert (got["x"]["n_obs"], got["x"]["n_units"], got["x"]["n_periods"]) == (len(d), 13, 60)


def test_pure_effects_vanish(spark):
    d = panel()
    d["y"] = d.unit.str[1:].astype(int) * 3.0 + d.t * 0.5
    for frac in (1.0, 0.8):
        df = spark.createDataFrame(d.sample(frac=frac, random_state=1))
        out = fe.absorb(df, ["y"], unit="unit", period="t")
        assert out.agg(F.max(F.abs("y_within"))).first()[0] < 1e-8


def test_sparse_panels_converge_in_few_steps_and_keys_stay_apart(spark):
    # A chain of units, each sharing one period with the next, is the slowest case for alternating means.
    rng = np.random.default_rng(11)
    rows = [(r, u, p, 1e6 * (r == 2) + rng.normal(), rng.normal()) for r in (1, 2) for u in range(8) for p in range(2 * u, 2 * u + 3)]
    d = pd.DataFrame(rows, columns=["rep", "unit", "t", "y", "z"])
    out = fe.absorb(spark.createDataFrame(d), ["y", "z"], unit="unit", period="t", keys=["rep"], balanced=False, max_steps=20).toPandas()
    for rep, part in out.groupby("rep"):
        dummies = np.hstack([np.eye(len(set(v)))[np.unique(v, return_inverse=True)[1]] for v in (part.unit, part.t)])
        for c in ("y", "z"):
            want = part[c] - dummies @ np.linalg.lstsq(dummies, part[c], rcond=None)[0]
            assert np.allclose(part[f"{c}_within"], want, atol=1e-7), (rep, c)
    with pytest.raises(DataGuardError):
        fe.absorb(spark.createDataFrame(d), ["z"], unit="unit", period="t", keys=["rep"], balanced=False, max_steps=2)


def test_units_without_common_periods_are_refused(spark):
    d = panel(units=6, periods=12)
    d = d[(d.unit.str[1:].astype(int) % 2) == (d.t % 2)]
    df = spark.createDataFrame(d)
    got = {r["unit"]: r["component"] for r in fe.panel_components(df, unit="unit", period="t").collect()}
    assert got == {u: int(u[1:]) % 2 for u in d.unit.unique()}
    run = dict(outcome="y", regressors=["x"], unit="unit", period="t", bootstrap_draws=9)
    with pytest.raises(DataGuardError, match="3 units from 0, 3 units from 1"):
        fe.two_way_regression(df, **run, connected=True)
    assert fe.two_way_regression(df, **run).count() == 1
    fe.require_connected(spark.createDataFrame(panel(units=3, periods=4)), unit="unit", period="t")


@pytest.mark.parametrize("names, target", [(["x"], 0), (["x", "x2"], 0), (["x", "x2"], 1)])
def test_enumerated_bootstrap_is_exact(spark, names, target):
    d = panel(units=6, periods=12)
    within = fe.absorb(spark.createDataFrame(d), ["y", *names], unit="unit", period="t")
    blocks = fe.cluster_blocks(within, outcome="y_within", regressors=[f"{n}_within" for n in names], cluster="unit")
    got = fe.bootstrap_t(blocks, len(names), seed=None).filter(F.col("target") == target).orderBy("draw").toPandas()
    assert np.allclose(got["t_star"], plain_enumerated(d, names, target), rtol=1e-6)


def test_signs_are_bits_of_hashes_and_draws_agree_with_a_plain_loop(spark):
    whole = draws.signs(3, ["a:0", "b:0"], 0, 300)
    assert np.array_equal(draws.signs(3, ["b:0"], 120, 260), whole[1:, 120:260])
    digest = hashlib.md5(b"3:1:a:0").hexdigest()
    assert [int(w > 0) for w in whole[0, 128:256]] == [int(b) for b in f"{int(digest, 16):0128b}"]
    assert abs(whole.mean()) < 0.15
    d = panel(units=5, periods=10)
    x, y, inverse, *_ = plain_fit(d, ["x"])
    codes, units = pd.factorize(d.unit, sort=True)
    within = fe.absorb(spark.createDataFrame(d), ["y", "x"], unit="unit", period="t")
    blocks = fe.cluster_blocks(within, outcome="y_within", regressors=["x_within"], cluster="unit")
    got = fe.bootstrap_t(blocks.repartition(5), 1, count=150, seed=3).orderBy("draw").toPandas()["t_star"].to_numpy()
    w = draws.signs(3, [f"{u}:0" for u in units], 0, 150)
    for k in range(150):
        star = y * w[codes, k]
        b = inverse @ x.T @ star
        scores = [(x[codes == g].T @ (star - x @ b)[codes == g]).item() for g in range(5)]
        assert got[k] == pytest.approx(b.item() / (inverse.item() * np.sqrt(np.square(scores).sum())), rel=1e-8)


def test_bootstrap_is_seeded_and_partition_free(spark):
    df = spark.createDataFrame(panel(beta=0.1))

    def p(seed, parts):
        return fe.two_way_regression(df.repartition(parts), outcome="y", regressors=["x"], unit="unit", period="t",
                                     bootstrap_draws=199, seed=seed).first()["wild_p_value"]

    first = p(7, 1)
    assert first == p(7, 8) and abs(first - p(8, 4)) < 0.15


def test_size_under_the_null_and_small_sample_switch(spark):
    d = pd.concat([panel(units=9, periods=30, beta=0.0, seed=s).assign(rep=s) for s in range(40)])
    df = spark.createDataFrame(d)
    within = fe.absorb(df, ["y", "x"], unit="unit", period="t", keys=["rep"], balanced=True)
    blocks = fe.cluster_blocks(within, outcome="y_within", regressors=["x_within"], cluster="unit", keys=["rep"]).cache()
    p = fe.infer(blocks, ["x"], keys=["rep"], bootstrap_draws=199).toPandas()
    assert len(p) == 40 and (p["wild_p_value"] <= 0.05).mean() <= 0.15
    both = fe.infer(blocks, ["x"], keys=["rep"], bootstrap_draws=199, small_sample_bootstrap=True).toPandas()
    # The correction shrinks every bootstrap t, so fewer of them exceed the observed one.
    gap = p.set_index("rep")["wild_p_value"] - both.set_index("rep")["wild_p_value"]
    assert (gap > -1e-12).all() and (gap > 0.001).any()


def test_no_rows_is_an_error(spark):
    df = spark.createDataFrame(panel(units=2, periods=2)).withColumn("y", F.lit(None).cast("double"))
    with pytest.raises(DataGuardError):
        fe.two_way_regression(df, outcome="y", regressors=["x"], unit="unit", period="t")


@pytest.mark.parametrize("unit_effects, period_effects, by", [(True, False, "unit"), (False, True, "t"), (False, False, None)])
def test_one_set_of_effects(spark, unit_effects, period_effects, by):
    d = panel()
    out = fe.absorb(spark.createDataFrame(d), ["y"], unit="unit", period="t", unit_effects=unit_effects,
                    period_effects=period_effects).toPandas().sort_values(["unit", "t"])
    want = d.y - d.groupby(by).y.transform("mean") if by else d.y
    assert np.allclose(out["y_within"].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("frac", [1.0, 0.85])
def test_placebo_equals_a_direct_fit_also_with_constant_severity(spark, frac):
    d = panel(units=6, periods=40)
    d.loc[d.unit == d.unit.iloc[0], "severity"] = 1.5
    d = d.sample(frac=frac, random_state=2)
    df = spark.createDataFrame(d)
    run = dict(outcome="y", severity="severity", unit="unit", period="t", mde=0.1, replications=30, bootstrap_draws=49)
    got = sim.placebo(df, **run).orderBy("replication").toPandas()
    scores = sim.unit_scores(df, "unit", replications=30, seed=draws.SEED).toPandas()
    dummies = np.hstack([np.ones((len(d), 1)), *[np.eye(len(set(v)))[np.unique(v, return_inverse=True)[1]] for v in (d.unit, d.t)]])
    residual = np.eye(len(d)) - dummies @ np.linalg.pinv(dummies)
    y = residual @ d.y.to_numpy()
    for k, row in got.iterrows():
        s = scores[scores.replication == row.replication].set_index("unit").score
        x = residual @ (d.unit.map(s).to_numpy() * d.severity.to_numpy())
        assert np.isclose(row.estimate, x @ y / (x @ x), atol=1e-6)
    assert set(got.n_obs) == {len(d)} and set(got.n_clusters) == {6} and len(got) == 30
    assert np.allclose(got["abs_estimate_over_mde"], got["estimate"].abs() / 0.1)


def test_power_rises_and_balance_does_not_matter(spark):
    # Seven units have 128 sign vectors, two of which always reach the observed t; thirteen leave that no weight.
    df = spark.createDataFrame(panel(units=13, periods=20))
    run = dict(outcome="y", unit="unit", period="t", severity="severity", simulations=12, bootstrap_draws=99,
               effect_grid=[0.0, 0.4, 3.0], target_power=0.7)
    curve, summary = sim.power_curve(df, **run)
    fast = curve.orderBy("effect_id").toPandas()
    slow = sim.power_curve(df, balanced=False, **run)[0].orderBy("effect_id").toPandas()
    assert np.allclose(fast["power"], slow["power"])
    assert fast["power"].iloc[0] <= 0.4 and fast["power"].iloc[2] >= 0.8
    row = summary.first()
    assert row["mde"] in (0.4, 3.0) and row["n_clusters"] == 13 and row["size_at_zero"] == fast["power"].iloc[0]


def test_power_on_an_unbalanced_panel(spark):
    d = panel(units=5, periods=15).sample(frac=0.9, random_state=3)
    curve, _ = sim.power_curve(spark.createDataFrame(d), outcome="y", unit="unit", period="t", severity="severity",
                               simulations=5, bootstrap_draws=19, effect_grid=[0.0, 3.0])
    got = {r["effect"]: r["power"] for r in curve.collect()}
    assert got[3.0] >= got[0.0]


@pytest.mark.parametrize("frac", [1.0, 0.8])
def test_leave_one_out_equals_refitting(spark, frac):
    d = panel(units=6, periods=15).sample(frac=frac, random_state=4)
    got = {r["left_out"]: r["estimate"] for r in sim.leave_one_unit_out(
        spark.createDataFrame(d), outcome="y", regressor="x", unit="unit", period="t").collect()}
    for u in d.unit.unique():
        assert got[u] == pytest.approx(plain_fit(d[d.unit != u], ["x"])[3][0], rel=1e-6)
    share = sim.sign_consistency(spark.createDataFrame([(k, v) for k, v in got.items()], "left_out string, estimate double")).first()
    assert share["n_units"] == 6 and 0.5 <= share["share_same_sign"] <= 1


def test_scores_are_standard_and_constant_within_a_unit(spark):
    df = spark.createDataFrame(panel(units=9, periods=5))
    out = sim.simulated_interaction(df, unit="unit", severity="severity", seed=3).toPandas()
    scores = out.groupby("unit")["score"].agg(["min", "max"])
    assert np.allclose(scores["min"], scores["max"])
    assert scores["min"].mean() == pytest.approx(0, abs=1e-9) and scores["min"].std(ddof=0) == pytest.approx(1)


def test_interaction_uncovered_unit_leaves_the_regression(spark):
    d = panel(units=6, periods=20).rename(columns={"severity": "cwv"}).assign(outcome=0.0)
    features = spark.createDataFrame([(f"z{k:02d}", float(k) if k else None) for k in range(6)], "unit string, f_z double")
    merged = inter.interaction_panel(spark.createDataFrame(d), features, unit="unit", forecast="y", outcome="outcome",
                                     severity_source="cwv", names=["f"])
    row = merged.agg(F.avg("cold_severity_z"), F.stddev_pop("cold_severity_z"), F.corr("cold_severity_z", "cwv")).first()
    assert tuple(row) == pytest.approx((0, 1, -1), abs=1e-9)
    test = inter.interaction_test(merged, feature="f", role="primary", mde=1e-9, unit="unit", period="t", bootstrap_draws=49).first()
    assert test["n_clusters"] == 5 and test["n_obs"] == 100 and test["detectable"]


def test_family_threshold(spark):
    df = spark.createDataFrame([("primary", 0.04), ("secondary", 0.01), ("secondary", 0.03)], "role string, wild_p_value double")
    got = {(r["role"], r["wild_p_value"]): (r["threshold"], r["significant"]) for r in inter.with_threshold(df).collect()}
    assert got["primary", 0.04] == (0.05, True) and got["secondary", 0.03] == (0.025, False)


def test_linear_fit_and_components(spark):
    d = panel(units=8, periods=40)
    fit = {r["term"]: r for r in sim.linear_fit(spark.createDataFrame(d), outcome="y", regressors=["x", "x2"]).collect()}
    design = np.column_stack([np.ones(len(d)), d.x, d.x2])
    beta = np.linalg.lstsq(design, d.y, rcond=None)[0]
    assert [fit[t]["coefficient"] for t in ("intercept", "x", "x2")] == pytest.approx(list(beta))
    shares = [r["variance_share"] for r in sim.component_shares(spark.createDataFrame(d), ["x", "x2", "y"]).collect()]
    want = np.linalg.eigvalsh(d[["x", "x2", "y"]].corr().to_numpy())[::-1] / 3
    assert shares == pytest.approx(list(want))


def test_repeated_cells_keep_their_weight(spark):
    d = pd.concat([panel(units=5, periods=8, seed=1), panel(units=5, periods=8, seed=2)])
    df = spark.createDataFrame(d)
    assert fe.is_balanced(df, unit="unit", period="t") and not fe.is_balanced(df, unit="unit", period="t", single=True)
    got = {r["left_out"]: r["estimate"] for r in sim.leave_one_unit_out(df, outcome="y", regressor="x", unit="unit", period="t").collect()}
    for u in d.unit.unique():
        assert got[u] == pytest.approx(plain_fit(d[d.unit != u], ["x"])[3][0], rel=1e-6)
