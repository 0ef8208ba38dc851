import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import serial


def plain_effective_n(x, max_lag=48):
    n = len(x)
    if n < 3:
        return max(n, 1)
    c = x - x.mean()
    total, scale = 1.0, c @ c
    if scale == 0:
        return n
    for k in range(1, min(max_lag, n - 1) + 1):
        rho = c[:-k] @ c[k:] / scale
        if rho <= 0:
            break
        total += 2 * rho
    return max(n / total, 1.0)


def plain_dm(a, b, power=2, max_lag=48):
    d = np.abs(a) ** power - np.abs(b) ** power
    n, c = len(d), d - d.mean()
    lags = min(max_lag, n - 1)
    v = c @ c / n + sum(2 * (1 - k / (lags + 1)) * (c[:-k] @ c[k:]) / n for k in range(1, lags + 1))
    z = d.mean() / math.sqrt(v / n)
    return z, math.erfc(abs(z) / math.sqrt(2))


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    ar = np.zeros(3000)
    for k in range(1, 3000):
        ar[k] = 0.95 * ar[k - 1] + rng.normal()
    parts = [pd.DataFrame({"g": "ar", "t": range(3000), "x": ar}), pd.DataFrame({"g": "noise", "t": range(1500), "x": rng.normal(size=1500)}),
             pd.DataFrame({"g": "two", "t": [0, 1], "x": [1.0, 2.0]}), pd.DataFrame({"g": "flat", "t": range(100), "x": 2.0}),
             pd.DataFrame({"g": "short", "t": range(9), "x": rng.normal(size=9)})]
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("chunk_rows", [10_000, 150, 23])
def test_effective_n_matches_the_formula_in_any_number_of_chunks(spark, frame, chunk_rows):
    df = spark.createDataFrame(frame.sample(frac=1, random_state=1))
    got = {r["g"]: r["n_effective"] for r in serial.effective_sample_size(
        df, value="x", order=["t"], group=["g"], chunk_rows=chunk_rows).collect()}
    for name, part in frame.groupby("g"):
        assert got[name] == pytest.approx(plain_effective_n(part["x"].to_numpy()), rel=1e-9), name
    assert got["ar"] < 500 and got["noise"] > 1200 and got["flat"] == 100


def test_single_series_without_group_and_with_uneven_times(spark, frame):
    part = frame[frame.g == "ar"].assign(t=lambda d: np.floor(d.t**1.5)).drop_duplicates("t")
    df = spark.createDataFrame(part)
    for size in (10_000, 97):
        row = serial.effective_sample_size(df, value="x", order=["t"], chunk_rows=size).first()
        assert row["n_effective"] == pytest.approx(plain_effective_n(part["x"].to_numpy()), rel=1e-9)


@pytest.mark.parametrize("chunk_rows", [10_000, 120])
def test_diebold_mariano(spark, chunk_rows):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=800).cumsum() / 10, rng.normal(size=800)
    df = spark.createDataFrame(pd.DataFrame({"t": range(800), "a": a, "b": b}))
    row = serial.diebold_mariano(df, error_a="a", error_b="b", order=["t"], chunk_rows=chunk_rows).first()
    z, p = plain_dm(a, b)
    assert row["statistic"] == pytest.approx(z, rel=1e-9) and row["p_value"] == pytest.approx(p, rel=1e-9)
    one = serial.diebold_mariano(df, error_a="a", error_b="b", order=["t"], power=1, max_lag=5).first()
    assert one["statistic"] == pytest.approx(plain_dm(a, b, 1, 5)[0], rel=1e-9)


def test_several_values_at_once_with_missing_keys_and_a_large_mean(spark):
    rng = np.random.default_rng(7)
    part = pd.DataFrame({"t": range(900), "g": ["a", None, "b"] * 300, "x": 1e8 + rng.normal(size=900).cumsum(), "y": rng.normal(size=900)})
    part.loc[part.t % 50 == 7, "y"] = None
    for chunk_rows in (5000, 60):
        out = serial.lag_products_of(spark.createDataFrame(part), values={"x": "x", "twice": F.col("y") * 2}, order=["t"], group=["g"],
                                     max_lag=10, chunk_rows=chunk_rows).collect()
        assert len(out) == 6
        for r in out:
            mine = part[(part.g.isna() if r["g"] is None else part.g == r["g"]) & part.y.notna()]
            v = mine["x"].to_numpy() if r["label"] == "x" else 2 * mine["y"].to_numpy()
            c = v - v.mean()
            assert r["n"] == len(v) and r["mean"] == pytest.approx(v.mean(), rel=1e-12)
            assert np.allclose(r["lag_products"], [c[k:] @ c[:len(c) - k] for k in range(11)], rtol=1e-6)


def test_diebold_mariano_degenerate(spark):
    df = spark.range(50).select(F.col("id").alias("t"), F.rand(1).alias("a")).withColumn("b", F.col("a"))
    assert serial.diebold_mariano(df, error_a="a", error_b="b", order=["t"]).first()["statistic"] is None
    few = df.filter("t < 9").withColumn("b", F.lit(0.0))
    row = serial.diebold_mariano(few, error_a="a", error_b="b", order=["t"]).first()
    assert row["statistic"] is None and row["p_value"] is None and row["n"] == 9


def test_text_order_gives_the_same_sums_whole_and_in_blocks(spark, frame):
    df = spark.createDataFrame(frame).withColumn("name", F.format_string("%06d", F.col("t").cast("int")))
    want = {r["g"]: r["lag_products"] for r in serial.lag_products(df, value="x", order=["t"], group=["g"], max_lag=3).collect()}
    for chunk_rows in (10_000, 200):
        out = serial.lag_products(df, value="x", order=["name"], group=["g"], max_lag=3, chunk_rows=chunk_rows).collect()
        assert all(np.allclose(r["lag_products"], want[r["g"]]) for r in out) and len(out) == len(want)
