import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import scoring
from tests.test_serial import plain_effective_n

FORECASTS = {"a": "fa", "b": "fb"}


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame({"t": range(n), "unit": rng.choice(["u", "v", "w"], n), "season": rng.choice(["winter", "summer"], n),
                        "y": rng.normal(10, 3, n), "fa": rng.normal(10, 3, n), "fb": rng.normal(10, 3, n)})
    pdf.loc[5, "y"] = 0.0
    pdf.loc[[7, 8], "fb"] = np.nan
    pdf.loc[[20, 21], "season"] = None
    return pdf


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("y", "fa", "fb")})


def plain(part, column):
    e, a = part[column] - part["y"], part["y"].abs().replace(0, np.nan)
    return len(part), e.abs().mean(), np.sqrt((e**2).mean()), e.mean(), (e.abs() / a).mean() * 100


def test_all_breakdowns_on_identical_rows(spark, frame):
    out = scoring.score(to_spark(spark, frame), actual="y", forecasts=FORECASTS,
                        groupings=((), ("season",), ("unit",), ("season", "unit"))).collect()
    done = frame.dropna(subset=["y", "fa", "fb"])
    seen = 0
    for r in out:
        part = done
        if "season" in r["grouping"]:
            part = part[part.season.isna()] if r["season"] is None else part[part.season == r["season"]]
        if "unit" in r["grouping"]:
            part = part[part.unit == r["unit"]]
        want = plain(part, FORECASTS[r["model"]])
        assert (r["n"], r["mae"], r["rmse"], r["bias"], r["mape_pct"]) == pytest.approx(want, rel=1e-9)
        seen += 1
    assert seen == 2 * (1 + 3 + 3 + len(done.groupby(["season", "unit"], dropna=False)))


def test_effective_n_pooled_and_per_unit(spark, frame):
    df = to_spark(spark, frame)
    done = frame.dropna(subset=["y", "fa", "fb"])
    pooled = scoring.score_with_effective_n(df, actual="y", forecasts=FORECASTS, groupings=((), ("season",)), order=["t"])
    for r in pooled.collect():
        part = done if r["grouping"] == "all" else (
            done[done.season.isna()] if r["season"] is None else done[done.season == r["season"]])
        assert r["n_effective"] == pytest.approx(plain_effective_n((part[FORECASTS[r["model"]]] - part.y).to_numpy()), rel=1e-9)
    by_unit = scoring.score_with_effective_n(df, actual="y", forecasts={"a": "fa"}, order=["t"], series=["unit"]).collect()
    want = sum(plain_effective_n((p.fa - p.y).to_numpy()) for _, p in frame.dropna(subset=["fa", "y"]).groupby("unit"))
    assert by_unit[0]["n_effective"] == pytest.approx(want, rel=1e-9)


def test_empty_table_gives_no_rows_and_no_error(spark, frame):
    df = to_spark(spark, frame).filter("t < 0")
    rows = scoring.score(df, actual="y", forecasts=FORECASTS, groupings=((),)).collect()
    assert all(r["n"] == 0 and r["mae"] is None for r in rows)


def test_skill_and_pivot(spark, frame):
    scores = scoring.score(to_spark(spark, frame), actual="y", forecasts=FORECASTS, groupings=(("unit",),))
    table = {(r["unit"], r["model"]): r for r in scoring.skill_table(scores, reference="a", keys=["unit"]).collect()}
    assert table["u", "a"]["skill_pct"] == 0
    a, b = table["u", "a"]["mae"], table["u", "b"]["mae"]
    assert table["u", "b"]["skill_pct"] == pytest.approx((a - b) / a * 100)
    wide = scoring.models_as_columns(scores, by=["unit"], models=["a", "b"]).filter("unit = 'u'").first()
    assert (wide["a"], wide["b"]) == (a, b)
    assert spark.range(1).select(scoring.skill(F.lit(0.0), F.lit(1.0))).first()[0] is None


def test_quantile_bins_follow_right_closed_edges(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=300), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "e": rng.normal(size=300)}))
    got = scoring.quantile_bins(df, "x").toPandas()
    want = pd.qcut(got["x"], 10, labels=False)
    assert (got["bin"] == want).all()
    low = scoring.low_tail_block(df, value="x", error_column="e").first()
    assert low["n_days"] == int((x <= np.quantile(x, 0.1)).sum())


def test_gap_decomposition(spark, frame):
    pdf = frame.dropna(subset=["y", "fa", "fb"]).assign(fo=lambda d: d.y + 0.1)
    row = scoring.gap_decomposition(to_spark(spark, pdf), actual="y", incumbent="fa", baseline="fb", perfect_input="fo").first()
    base, own = pdf.fb - pdf.y, pdf.fa - pdf.y
    assert row["gap"] == pytest.approx(base.abs().mean() - own.abs().mean())
    assert row["input_error_cost"] == pytest.approx(base.abs().mean() - 0.1)
    assert row["constant_bias_cost"] == pytest.approx(base.abs().mean() - (base - base.mean()).abs().mean())
    assert row["error_correlation"] == pytest.approx(np.corrcoef(base, own)[0, 1])
