import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pitpanel.operators.guards import DataGuardError
from pitpanel.operators.pointintime import Gate
from pitpanel.sources import nested, publications, reference, register, series

TZ = "Europe/London"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_forecast_and_outcome_file(spark, tmp_path):
    path = write(tmp_path / "perf.csv", "Other,Date,SP,F,O,Pub\n"
                 "x,2024-07-15,1,100,110,2024-07-14 09:45:00\nx,15-Jul-2024,2,101,bad,2024-07-14 09:45:00\n"
                 "x,2024-07-15,1,105,111,2024-07-14 10:45:00\n")
    out = series.read_forecast_and_outcome(spark, path, date="Date", period="SP", measures={"forecast": "F", "outcome": "O"},
                                           published="Pub", tz=TZ)
    rows = out.orderBy("settlement_datetime").collect()
    assert [r["settlement_datetime"] for r in rows] == [dt.datetime(2024, 7, 14, 23, 30), dt.datetime(2024, 7, 15, 0, 0)]
    assert rows[0]["forecast"] == 105 and rows[0]["published_at"] == dt.datetime(2024, 7, 14, 9, 45)
    assert rows[1]["outcome"] is None


def test_unknown_layout_stops_the_load(spark, tmp_path):
    path = write(tmp_path / "perf.csv", "Date,SP,F,Pub\n15/07/2024,1,100,2024-07-14 09:45:00\n")
    with pytest.raises(DataGuardError, match="15/07/2024"):
        series.read_forecast_and_outcome(spark, path, date="Date", period="SP", measures={"f": "F"}, published="Pub", tz=TZ)
    with pytest.raises(DataGuardError, match="missing columns"):
        series.read_text_csv(spark, path, ["Date", "Nope"])


def test_yearly_files(spark, tmp_path):
    files = {2023: write(tmp_path / "a.csv", "D,P,ND,X\n01-Jan-23,1,5,9\n01-Jan-23,51,5,9\n"),
             2024: write(tmp_path / "b.csv", "X,D,P,ND\n9,2024-01-01,1,6\n9,2024-01-01,0,6\n")}
    out = series.read_yearly_series(spark, files, [2023, 2024], date="D", period="P", measures={"nd_mw": "ND"}, tz=TZ)
    assert sorted((r["settlement_date"].year, r["nd_mw"]) for r in out.collect()) == [(2023, 5.0), (2024, 6.0)]
    with pytest.raises(KeyError, match="2025"):
        series.read_yearly_series(spark, files, [2025], date="D", period="P", measures={"nd_mw": "ND"}, tz=TZ)


def record(day, unit, stamp, value, item="Demand Forecast, LDZ ({})"):
    return {"applicableFor": day, "itemName": item.format(unit), "generatedTimeStamp": stamp, "value": value, "UnitOfMeasure": "mscm"}


def test_publication_series(spark, tmp_path):
    # Two runs before the day and one on it; the latest is the outturn, the one before it the last forecast.
    told = [("27/02/2032 06:05:00", "2.25"), ("28/02/2032 23:59:59", "3.5"), ("29/02/2032 00:00:00", "7.75")]
    rows = [record("29/02/2032", u, s, v) for u in ("EA", "SC") for s, v in told]
    root = str(tmp_path)
    for name in ("demand_forecast", "demand_actual_d_plus_1", "cwv_forecast_d_minus_1", "cwv_actual"):
        write(tmp_path / f"series={name}" / "part.json", json.dumps(rows))
    codes = ["EA", "SC"]
    out = publications.read_forecast(spark, root, codes).collect()
    assert {(r["ldz"], r["ng_forecast_mscm"]) for r in out} == {("EA", 3.5), ("SC", 3.5)}
    first = publications.read_forecast(spark, root, codes, gate=Gate.FIRST_BEFORE_DAY).collect()
    assert {r["ng_forecast_mscm"] for r in first} == {2.25}
    actual = publications.read_actuals(spark, root, codes).collect()
    assert {r["demand_mscm"] for r in actual} == {7.75} and actual[0]["unit"] == "mscm"
    assert publications.read_weather_index(spark, root, codes).columns == ["gas_day", "ldz", "cwv_forecast", "cwv_published_at"]
    assert "cwv_actual_realised" in publications.read_weather_index(spark, root, codes, kind="actual").columns
    with pytest.raises(ValueError):
        publications.read_actuals(spark, root, codes, vintage_run="d_plus_2")
    with pytest.raises(ValueError):
        publications.read_weather_index(spark, root, codes, kind="other")
    with pytest.raises(DataGuardError, match="absent"):
        publications.read_actuals(spark, root, [*codes, "NW"])
    with pytest.raises(DataGuardError, match="unparseable unit"):
        publications.read_actuals(spark, root, ["EA"])
    assert publications.read_publications(spark, root, "demand_forecast", codes).count() == 6


def test_bad_publication_time_is_refused(spark):
    raw = spark.createDataFrame([record("2025-01-15", "EA", "14/01/2025 13:15:00", "1")], publications.RECORD)
    with pytest.raises(DataGuardError, match="times"):
        publications.parse_publications(raw, ["EA"])


def body(times, values, name="temperature_2m"):
    return {"hourly": {"time": times, name: values}}


def responses(spark, payload, points):
    return spark.createDataFrame([(json.dumps(payload), points)], "body string, point_ids array<string>")


def test_hourly_arrays(spark):
    t = ["2024-01-01T00:00", "2024-01-01T01:00"]
    out = nested.hourly_rows(responses(spark, [body(t, [1.5, None]), body(t, [3, "x"])], ["a", "b"]), variable="temperature_2m", value="v")
    rows = sorted((r["point_id"], r["time_utc"], r["v"]) for r in out.fillna(-1, ["v"]).collect())
    assert [(p, x) for p, _, x in rows] == [("a", 1.5), ("a", -1.0), ("b", 3.0), ("b", -1.0)]
    assert rows[1][1] == dt.datetime(2024, 1, 1, 1)
    single = nested.hourly_rows(responses(spark, body(t, [1, 2]), ["a"]), variable="temperature_2m", value="v")
    assert single.count() == 2
    for payload in ([body(t, [1, 2])], [body(t, [1]), body(t, [1, 2])]):
        with pytest.raises(PySparkException, match="differ in number"):
            nested.hourly_rows(responses(spark, payload, ["a", "b"]), variable="temperature_2m", value="v").collect()


def test_forecast_lead_and_archive_guards(spark):
    rows = responses(spark, body(["2024-02-05T00:00"], [4.0], "temperature_2m_previous_day1"), ["a"])
    args = dict(start=dt.date(2024, 2, 4), end=dt.date(2024, 3, 1), archive_start=dt.date(2024, 2, 4))
    assert nested.forecast_temperature(rows, lead_days=1, **args).first()["temp_c_forecast"] == 4.0
    with pytest.raises(DataGuardError, match="1..7"):
        nested.forecast_temperature(rows, lead_days=8, **args)
    with pytest.raises(DataGuardError, match="archive"):
        nested.forecast_temperature(rows, lead_days=1, **{**args, "start": dt.date(2024, 2, 3)})
    real = responses(spark, body(["2024-02-05T00:00"], [4.0]), ["a"])
    assert nested.realised_temperature(real, start=args["start"], end=args["end"]).columns[-1] == "temp_c_realised"


def test_landed_bodies_know_their_points(spark, tmp_path):
    write(tmp_path / "one.json", json.dumps(body(["2024-02-05T00:00"], [4.0])))
    bodies = nested.response_points(nested.read_bodies(spark, str(tmp_path)), {"one.json": ["p1"]})
    assert nested.hourly_rows(bodies, variable="temperature_2m", value="v").first()["point_id"] == "p1"


def test_features_and_holidays(spark):
    page = {"features": [{"attributes": {"code": "E1", "pop": "10"}, "geometry": {"x": -0.1, "y": 51.5}}]}
    row = nested.feature_rows(spark.createDataFrame([(json.dumps(page),)], "body string"), ["code", "pop"]).first()
    assert tuple(row) == ("E1", "10", -0.1, 51.5)
    days = {"england": {"events": [{"title": "New Year", "date": "2024-01-01"}]}, "scotland": {"events": [
        {"title": "2nd January", "date": "2024-01-02"}]}, "other": {"events": []}}
    out = nested.holiday_rows(spark.createDataFrame([(json.dumps(days),)], "body string"), ["england", "scotland"])
    assert {(r["date"].day, r["division"]) for r in out.collect()} == {(1, "england"), (2, "scotland")}


def test_population_points(spark):
    cent = spark.createDataFrame([("a", 51.0, 0.0), ("b", 52.0, 0.0)], "area_code string, latitude double, longitude double")
    pop = spark.createDataFrame([("a", "10"), ("b", "0")], "area_code string, population string")
    other = spark.createDataFrame([("s", 56.0, -3.0, "5"), ("t", None, -3.0, "5")],
                                  "area_code string, latitude double, longitude double, population string")
    out = reference.population_points(cent, pop, other)
    assert {(r["area_code"], r["country"], r["population"]) for r in out.collect()} == {("a", "EW", 10.0), ("s", "S", 5.0)}
    with pytest.raises(DataGuardError, match="1 of 2"):
        reference.population_points(cent, pop.filter("area_code = 'a'"), other)


def test_zone_lookup(spark, tmp_path):
    head = "Outcode,Incode,LDZ,Exit Zone\n"
    sheets = {"g1": write(tmp_path / "1.csv", head + "QZ7,3KD,ea,west 3\nQZ7,3KD,SC,east 1\nB,9,EA,west 3\nX4, 8UU ,,west 3\n"),
              "g2": write(tmp_path / "2.csv", head + "YY20,5RT,SC,north\nWD3,6GH,LC,other\n")}
    out = reference.zone_lookup(spark, sheets, codes=["EA", "SC"], other_codes=["LC"])
    assert {(r["postcode"], r["outcode"], r["ldz"], r["gdn"], r["is_nts"]) for r in out.collect()} == {
        ("QZ73KD", "QZ7", "EA", "g1", True), ("YY205RT", "YY20", "SC", "g2", True), ("WD36GH", "WD3", "LC", "g2", False)}
    with pytest.raises(DataGuardError, match="absent \\['NW'\\]"):
        reference.zone_lookup(spark, sheets, codes=["EA", "SC", "NW"], other_codes=["LC"])


def register_csv(rows):
    names = [*register.REGISTER_COLUMNS, "unused"]
    lines = [",".join(names)]
    for r in rows:
        lines.append(",".join(f'"{r.get(n, "")}"' for n in names))
    return "\n".join(lines) + "\n"


def test_register_extract_resumes_prunes_and_dedupes(spark, tmp_path):
    files = {
        2022: write(tmp_path / "2022.csv", register_csv([
            {"certificate_number": "c1", "uprn": "7", "lodgement_date": "2022-05-01", "walls_description": "Solid, \nbrick", "postcode": "SM1 4PY"},
            {"certificate_number": "c2", "lodgement_date": "bad"}, {"certificate_number": "c3", "lodgement_date": "2022-01-01"}])),
        2023: write(tmp_path / "2023.csv", register_csv([
            {"certificate_number": "c4", "uprn": "7", "lodgement_date": "2023-06-01", "postcode": "X4 8UU"},
            {"certificate_number": "c5", "uprn": "7", "lodgement_date": "2023-12-24"}])),
        2024: str(tmp_path / "never-opened.csv"),
    }
    as_of, target = dt.date(2023, 11, 30), str(tmp_path / "slim")
    assert register.extract_slim(spark, {2022: files[2022]}, target, as_of=as_of) == [2022]
    assert register.extract_slim(spark, files, target, as_of=as_of) == [2023]
    assert register.extract_slim(spark, files, target, as_of=as_of) == []
    slim = register.read_slim(spark, target, as_of=as_of)
    assert slim.count() == 3
    assert register.read_slim(spark, target, as_of=dt.date(2022, 12, 31)).filter(F.col("uprn") == "7").count() == 1
    out = {r["addr_key"]: r for r in register.dwellings(slim, as_of=as_of).collect()}
    assert set(out) == {"entity 7", "record c3"} and out["entity 7"]["postcode"] == "X4 8UU"
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cert_year" in plan


def test_unreadable_periods_times_and_holidays_fail_the_load(spark, tmp_path):
    path = write(tmp_path / "bad.csv", "Date,SP,F,Pub\n2024-07-15,1,1,2024-07-14 09:45:00\n2024-07-15,x,2,2024-07-14 09:45:00\n")
    with pytest.raises(Exception, match="unreadable settlement period"):
        series.read_forecast_and_outcome(spark, path, date="Date", period="SP", measures={"f": "F"}, published="Pub", tz=TZ).collect()
    hours = json.dumps([{"hourly": {"time": ["2024-01-01T00:00", "soon"], "temperature_2m": ["1", "2"]}}])
    for body_text, message in ((hours, "unreadable time"), (None, "response empty")):
        bodies = spark.createDataFrame([(body_text, ["a"])], "body string, point_ids array<string>")
        with pytest.raises(Exception, match=message):
            nested.hourly_rows(bodies, variable="temperature_2m", value="v").collect()
    days = {"north": {"events": [{"title": "x", "date": "2024-13-01"}]}}
    for text, wanted, message in ((json.dumps(days), ["north"], "unreadable holiday"), (json.dumps(days), ["south"], "division is absent"),
                                  (None, ["north"], "division is absent")):
        with pytest.raises(Exception, match=message):
            nested.holiday_rows(spark.createDataFrame([(text,)], "body string"), wanted).collect()
