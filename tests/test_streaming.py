import datetime as dt

from pyspark.sql import functions as F

from pitpanel.operators import pointintime as pit
from pitpanel.streaming import live

SCHEMA = "day date, unit string, at timestamp_ntz, value double, id bigint"
NAMES = dict(day="day", unit="unit", published="at", value="value", tie_break="id")


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def drain(stream, root, mode="append"):
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def told(key, unit, days_before, hour, value, day=dt.date(2031, 3, 9)):
    """A publication for ``day``, so many days before it."""
    return day, unit, dt.datetime.combine(day - dt.timedelta(days=days_before), dt.time(hour, 40)), value, key


def test_late_publication_never_changes_an_emitted_gate(spark, tmp_path):
    source, later = tmp_path / "in", dt.date(2031, 3, 12)
    land(spark, source, [told(71, "west", 2, 7, 4.5), told(72, "west", 1, 20, 6.25), told(73, "east", 1, 3, 1.0)])

    def gate():
        feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        return live.live_gate(feed, **NAMES, horizon="1 day")

    assert drain(gate(), tmp_path / "q").count() == 0  # the gate is still open
    land(spark, source, [told(74, "west", 0, 8, -3.0), told(75, "west", 1, 6, 8.0, later)])
    drain(gate(), tmp_path / "q")
    land(spark, source, [told(76, "west", 1, 23, 77.0), told(77, "west", 1, 6, 9.0, later + dt.timedelta(days=1))])
    out = drain(gate(), tmp_path / "q").filter("day = date'2031-03-09'").collect()
    assert {(r["unit"], r["value"], r["at"].hour) for r in out} == {("west", 6.25, 20), ("east", 1.0, 3)} and len(out) == 2


def feed_rows():
    first = dt.date(2031, 6, 1)
    return [[told(100 * k + 10 * h + j, unit, 1 + (h == 2), 4 + 7 * h, k - j + h / 8, first + dt.timedelta(days=k)) for h in range(3) for j, unit in enumerate("xyz")]
            for k in range(9)]


def test_stream_equals_batch_once_the_feed_has_ended(spark, tmp_path):
    source = tmp_path / "in"
    for rows in feed_rows():
        land(spark, source, rows)
    for gate in (pit.Gate.LAST_BEFORE_DAY, pit.Gate.FIRST_BEFORE_DAY):
        root, ended = tmp_path / gate.name, str(tmp_path / gate.name / "ended")

        def stream():
            feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(source))
            return live.live_gate(live.with_markers(feed, ended, flag="over"), **NAMES, gate=gate, horizon="2 days", ended="over")

        live.open_feed(spark, ended, flag="over")
        before = sorted(map(tuple, drain(stream(), root).collect()))
        batch = pit.select_at_gate(spark.read.schema(SCHEMA).parquet(str(source)), gate=gate, day="day", unit="unit",
                                   published="at", value="value", tie_break=["id"])
        want = sorted(map(tuple, batch.select("day", "unit", "value", "at").collect()))
        assert 0 < len(before) < len(want) == 27 and set(before) < set(want)
        assert sorted(map(tuple, drain(stream(), root).collect())) == before  # a restart emits nothing twice
        live.end_feed(spark, ended, flag="over")
        assert sorted(map(tuple, drain(stream(), root).collect())) == want
        live.end_feed(spark, ended, flag="over")  # a second marker changes nothing
        assert sorted(map(tuple, drain(stream(), root).collect())) == want


def test_rows_after_the_end_of_a_feed_are_late(spark, tmp_path):
    source, ended, root = tmp_path / "in", str(tmp_path / "ended"), tmp_path / "q"
    land(spark, source, [told(1, "x", 1, 9, 2.0), told(2, "x", 1, 11, 3.0)])

    def stream():
        feed = spark.readStream.schema(SCHEMA).parquet(str(source))
        return live.live_gate(live.with_markers(feed, ended, flag="over"), **NAMES, ended="over")

    live.open_feed(spark, ended, flag="over")
    drain(stream(), root)
    live.end_feed(spark, ended, flag="over")
    assert [r["value"] for r in drain(stream(), root).collect()] == [3.0]
    land(spark, source, [told(3, "x", 1, 12, 50.0), told(4, "x", 1, 12, 60.0, dt.date(2031, 5, 1))])
    assert [r["value"] for r in drain(stream(), root).collect()] == [3.0]


def test_business_days_and_late_rows(spark, tmp_path):
    schema, source = "ts timestamp_ntz, v double", tmp_path / "in"
    stamps = ["2024-01-15 04:59:00", "2024-01-15 05:00:00", "2024-01-16 04:59:00", "2024-01-17 07:00:00"]

    def put(values):
        spark.createDataFrame([(dt.datetime.fromisoformat(s), 1.0) for s in values], schema).coalesce(1).write.mode("append").parquet(str(source))

    def totals():
        feed = spark.readStream.schema(schema).parquet(str(source))
        return live.live_business_days(feed, time="ts", keys=[], aggregates=[F.sum("v").alias("v")])

    put(stamps)
    drain(totals(), tmp_path / "q")
    put(["2024-01-15 12:00:00", "2024-01-19 07:00:00"])  # the first is too late to count
    got = {r["business_day"].day: r["v"] for r in drain(totals(), tmp_path / "q").collect()}
    assert got == {14: 1.0, 15: 2.0, 17: 1.0}


def test_upsert_log_is_replayable_and_compacts(spark, tmp_path):
    path, keys, order = str(tmp_path / "log"), ["k"], ["at", "id"]

    def batch(rows):
        return spark.createDataFrame(rows, "k string, at int, id int, v string")

    write = live.append_latest(path, keys=keys, order=order)
    write(batch([("a", 1, 1, "old"), ("a", 2, 2, "new"), ("b", 1, 3, "b")]), 0)
    write(batch([("a", 1, 9, "late"), ("b", 5, 4, "b2")]), 1)
    write(batch([("a", 1, 9, "late"), ("b", 5, 4, "b2")]), 1)
    want = {"a": "new", "b": "b2"}
    assert {r["k"]: r["v"] for r in live.current_state(spark, path, keys=keys, order=order).collect()} == want
    live.compact(spark, path, str(tmp_path / "next"), keys=keys, order=order)
    again = live.current_state(spark, str(tmp_path / "next"), keys=keys, order=order)
    assert {r["k"]: r["v"] for r in again.collect()} == want
