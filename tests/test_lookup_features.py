import pytest
from pyspark.sql import functions as F

from pitpanel.operators import features as feat
from pitpanel.operators import lookup as lk
from pitpanel.operators.guards import DataGuardError, require_coverage, require_same_codes


@pytest.fixture(scope="module")
def lookup(spark):
    """K7 lies in one zone, Q2 in two, T30 has one key only and another flag."""
    rows = [("K72BD", "K7", "north", False), ("K75XW", "K7", "north", False), ("Q28LM", "Q2", "coast", True),
            ("Q21RT", "Q2", "hills", True), ("T303JH", "T30", "hills", True)]
    return spark.createDataFrame(rows, "postcode string, outcode string, ldz string, is_nts boolean")


@pytest.mark.parametrize("raw, zone, level, nts", [
    ("k7 2bd", "north", "full", False), ("  K7   5XW", "north", "full", False), ("K7 0AB", "north", "outcode", False),
    ("q2 1rt", "hills", "full", True), ("Q2 0AB", None, "none", None), ("t303jh", "hills", "full", True),
    ("T30 9AB", "hills", "outcode", True), ("V4 4AB", None, "none", None), ("", None, "none", None), (None, None, "none", None),
])
def test_two_tiers(spark, lookup, raw, zone, level, nts):
    out = lk.two_tier_lookup(spark.createDataFrame([(raw,)], "pc string"), key="pc", lookup=lookup).collect()
    assert [(r["ldz"], r["match_level"], r["is_nts"]) for r in out] == [(zone, level, nts)]


def test_row_count_is_kept_and_shares_add_up(spark, lookup):
    df = spark.createDataFrame([(key,) for key in ("K7 2BD", "T30 3JH", "K7 2BD", "K7 0AB", "V4 4AB", None, "q28lm", "K7 1AB")], "pc string")
    out = lk.two_tier_lookup(df, key="pc", lookup=lookup)
    assert out.count() == 8
    assert {r["match_level"]: r["share"] for r in lk.match_shares(out).collect()} == {"full": 0.5, "outcode": 0.25, "none": 0.25}


def test_ambiguous_keys_are_left_out(lookup):
    out = lk.unambiguous_keys(lookup, fine="postcode", coarse="outcode", target="ldz", flag="is_nts")
    assert {r["outcode"]: r["ldz"] for r in out.collect()} == {"K7": "north", "T30": "hills"}


def dwelling_rows(zone, n, sap, cavity_every=2):
    return [(zone, str(sap + k % 3), "80", f"England and Wales: {1900 + 10 * (k % 12)}-1999",
             "Cavity wall, filled" if k % cavity_every == 0 else "Solid brick, no insulation", "Poor" if k % 4 else "Good",
             "Y" if k % 3 else "n") for k in range(n)]


SCHEMA = ("ldz string, current_energy_efficiency string, total_floor_area string, construction_age_band string, "
          "walls_description string, walls_energy_eff string, mains_gas_flag string")


def test_stock_features_and_z_scores(spark):
    rows = dwelling_rows("A", 60, 50) + dwelling_rows("B", 61, 60, 3) + dwelling_rows("C", 65, 70, 4) + dwelling_rows("S", 2, 10)
    rows += [("A", "bad", "5000", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = spark.createDataFrame([(z,) for z in "ABCS"], "ldz string")
    raw = feat.stock_features(df, zone="ldz", expected=expected, min_dwellings=50)
    got = {r["ldz"]: r for r in raw.collect()}
    assert got["A"]["n_dwellings"] == 61 and got["A"]["mean_sap"] == pytest.approx(51.0)
    assert got["A"]["mean_floor_area"] == 80.0  # the out-of-range area leaves the mean
    assert got["A"]["share_solid_wall"] + got["A"]["share_cavity_wall"] == pytest.approx(1.0)
    assert not got["S"]["has_stock_coverage"] and got["A"]["has_stock_coverage"]
    columns = ["mean_sap", "share_solid_wall"]
    z = feat.standardise(raw, columns)
    row = z.filter("has_stock_coverage").agg(F.avg("mean_sap_z"), F.stddev_pop("mean_sap_z")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1)
    assert z.filter("ldz = 'S'").first()["mean_sap_z"] is None
    with pytest.raises(DataGuardError, match="mean_floor_area"):
        feat.standardise(raw, ["mean_floor_area"])
    with pytest.raises(DataGuardError, match="absent"):
        feat.stock_features(df.filter("ldz <> 'B'"), zone="ldz", expected=expected, min_dwellings=50)
    with pytest.raises(DataGuardError, match="covered"):
        feat.standardise(raw.filter("ldz in ('A', 'S')"), columns)


def test_clashing_names_get_a_suffix(spark):
    left = spark.createDataFrame([("a", 1)], "k string, n int")
    out = feat.join_without_clashes(left, spark.createDataFrame([("a", 2, 3)], "k string, n int, m int"), ["k"])
    assert out.columns == ["k", "n", "n_stock", "m"]


def test_code_sets_and_coverage(spark):
    codes = spark.createDataFrame([("a",), ("b",)], "c string")
    require_same_codes(codes.union(codes), "c", codes)
    with pytest.raises(DataGuardError, match="unknown \\['z'\\]"):
        require_same_codes(codes.union(spark.createDataFrame([("z",)], "c string")), "c", codes)
    left = spark.range(100)
    require_coverage(left, spark.range(99))
    with pytest.raises(DataGuardError, match="98 of 100"):
        require_coverage(left, spark.range(98))
