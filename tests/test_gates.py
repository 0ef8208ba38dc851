import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import pointintime as pit
from pitpanel.operators.guards import DataGuardError, missing_units, require_units

# Two publications on the calendar day before, one after midnight but before the business day
# opens at five, three too late; the latest values are not the largest.
HISTORY = [
    ("2023-06-07 06:40", 41.5), ("2023-06-07 19:05", 39.25), ("2023-06-08 04:59", 40.0), ("2023-06-08 05:00", 43.5),
    ("2023-06-08 12:30", 38.0), ("2023-06-09 01:00", 44.75),
]


def history(spark, rows=HISTORY, unit="u1", shift=0, add=0.0):
    day = dt.date(2023, 6, 8) + dt.timedelta(days=shift)
    data = [(day, unit, dt.datetime.fromisoformat(t) + dt.timedelta(days=shift), v + add) for t, v in rows]
    return spark.createDataFrame(data, "gas_day date, ldz string, generated_at timestamp_ntz, value double")


def choose(df, gate):
    return pit.select_at_gate(df, gate=gate, day="gas_day", unit="ldz", published="generated_at", value="value")


@pytest.mark.parametrize("gate, value", [
    (pit.Gate.FIRST_BEFORE_DAY, 41.5), (pit.Gate.LAST_BEFORE_DAY, 39.25), (pit.Gate.LAST_BEFORE_OPEN, 40.0),
])
def test_each_gate_sees_its_own_publication(spark, gate, value):
    rows = choose(history(spark), gate).collect()
    assert len(rows) == 1 and rows[0]["value"] == value
    assert rows[0]["generated_at"] < dt.datetime(2023, 6, 8, 5)


def test_nothing_legal_is_an_error_not_a_late_value(spark):
    late = history(spark, [r for r in HISTORY if r[0] >= "2023-06-08 05:00"])
    for gate in pit.Gate:
        chosen = choose(late, gate)
        assert chosen.count() == 0
        with pytest.raises(DataGuardError):
            pit.require_gated(chosen, gate)


def test_units_and_days_are_independent(spark):
    parts = [history(spark), history(spark, unit="u2", add=-7.5), *(history(spark, shift=k) for k in (1, 2, 6))]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    rows = choose(df, pit.Gate.LAST_BEFORE_DAY)
    assert rows.count() == 5 == rows.select("gas_day", "ldz").distinct().count()
    got = {r["ldz"]: r["value"] for r in rows.filter(F.col("gas_day") == "2023-06-08").collect()}
    assert got == {"u1": 39.25, "u2": 31.75}


def test_first_gate_admits_any_earlier_date(spark):
    df = history(spark, [("2023-05-30 23:59", 2.5), *HISTORY])
    assert choose(df, pit.Gate.FIRST_BEFORE_DAY).first()["value"] == 2.5


def test_latest_as_of_ignores_later_records_and_falls_back_to_the_record_id(spark):
    df = spark.createDataFrame([
        ("1", " 7 ", "2020-01-01", "a"), ("2", "7", "2021-01-01", "b"), ("3", "7", "2024-01-01", "c"),
        ("4", "", "2020-01-01", "d"), ("5", None, "2020-01-01", "e"), ("6", "7", "2021-01-01", "f"),
    ], "cert string, uprn string, lodged string, v string").withColumn("lodged", F.col("lodged").cast("date"))
    out = pit.latest_as_of(df, key=pit.entity_key("uprn", "cert"), recorded="lodged", record="cert", as_of="2023-11-30",
                           keep=["lodged", "v"])
    assert {r["entity_key"]: r["v"] for r in out.collect()} == {"entity 7": "f", "record 4": "d", "record 5": "e"}


def test_exact_lag_leaves_gaps(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(16) if k != 3]
    df = spark.createDataFrame([("u", d, float(d.day)) for d in days], "u string, d date, y double")
    got = {r["d"].day: r["n"] for r in pit.seasonal_naive(df, units=["u"], time="d", value="y", output="n").collect()}
    assert got[8] == 1.0 and got[11] is None and got[12] == 5.0 and got[1] is None


def test_vintage_diff_and_revisions(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    new = spark.createDataFrame([(2, 2.5), (3, None), (4, 4.0)], "k int, v double")
    out = pit.vintage_diff(old, new, keys=["k"], values=["v"])
    assert {r["k"]: r["change"] for r in out.collect()} == {1: "removed", 2: "changed", 3: "same", 4: "added"}
    pair = spark.createDataFrame([(10.0, 10.0), (10.0, 12.0), (None, 1.0)], "a double, b double")
    row = pit.revision_stats(pair, first="a", final="b").first()
    assert (row["n"], row["mean_revision"], row["pct_of_mean_level"], row["share_equal"]) == (2, 1.0, 10.0, 0.5)


def test_missing_units(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "u string")
    df = spark.createDataFrame([("a", 1), (None, 2)], "u string, x int")
    assert [r[0] for r in missing_units(df, "u", expected).collect()] == ["b"]
    with pytest.raises(DataGuardError, match="b"):
        require_units(df, "u", expected)


def test_partition_count_does_not_change_the_choice(spark):
    df = history(spark).union(history(spark, add=1.0)).withColumn("id", F.monotonically_increasing_id())

    def run(parts):
        return pit.select_at_gate(df.repartition(parts), day="gas_day", unit="ldz", published="generated_at", value="value",
                                  tie_break=["id"]).collect()

    assert run(1) == run(8)


def test_restated_totals_equal_the_diff_of_two_vintages(spark):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("c", 2, 4.0), ("d", 1, None), ("e", 1, None), ("e", 2, 5.0), (None, 1, 6.0), (None, 2, 7.0),
            ("f", None, 8.0), ("f", 1, 0.0), ("g", None, 9.0)]
    lines = spark.createDataFrame(rows, "k string, day int, v double")

    def totals(df):
        return df.groupBy("k").agg(F.sum("v").alias("v"))

    known = F.col("day") <= 1
    want = pit.vintage_diff(totals(lines.filter(known)), totals(lines), keys=["k"], values=["v"])
    got = pit.restated_totals(lines, known, keys=["k"], totals={"v": "v"})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
