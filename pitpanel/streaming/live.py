"""Feeds as streams: late data must never change what a decision-maker saw."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.operators.pointintime import Gate, gate_allows, latest_per_key

#: Event time of an end-of-feed marker: later than any window, so that all of them close.
END_OF_FEED = "9999-01-01 00:00:00"


def with_markers(feed: DataFrame, path: str, *, flag: str) -> DataFrame:
    """``feed`` and the end-of-feed markers in the folder ``path`` as one stream; ``flag`` tells markers apart.

    A marker is a row of nulls. The folder must exist; ``end_feed`` puts one there once the feed
    has been read, and the next run of the query closes what is still open. Rows that come after it
    are late.
    """
    markers = feed.sparkSession.readStream.schema(f"{flag} boolean").parquet(path)
    blank = [F.lit(None).cast(field.dataType).alias(field.name) for field in feed.schema]
    return feed.withColumn(flag, F.lit(False)).unionByName(markers.select(*blank, flag))


def open_feed(spark: SparkSession, path: str, *, flag: str) -> None:
    """An empty folder of markers."""
    spark.createDataFrame([], f"{flag} boolean").write.mode("append").parquet(path)


def end_feed(spark: SparkSession, path: str, *, flag: str) -> None:
    """Put a marker into the folder; a second one changes nothing."""
    spark.createDataFrame([(True,)], f"{flag} boolean").write.mode("append").parquet(path)


def event_time(clock: Column) -> Column:
    """UTC wall clock as the TIMESTAMP a watermark needs, whatever the session time zone."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, clock.cast("timestamp_ntz")))


def live_gate(publications: DataFrame, *, day: str, unit: str, published: str, value: str, tie_break: str,
              gate: Gate = Gate.LAST_BEFORE_DAY, horizon: str = "2 days", open_hour: int = 5,
              ended: str | None = None) -> DataFrame:
    """The gated publication per (day, unit), emitted once when its gate has closed.

    The event time is the gate's closing time.  ``horizon`` is the longest lead at which a
    day is first published: a publication for a later gate then proves that all earlier
    gates beyond it have closed.  Later publications are filtered or find no state.
    A row with ``ended`` true (see ``with_markers``) closes all gates and is no publication.
    """
    hours = open_hour if gate is Gate.LAST_BEFORE_OPEN else 0
    closing = F.timestamp_seconds(F.unix_date(F.col(day)).cast("bigint") * 86400 + hours * 3600)
    allowed = gate_allows(gate, F.col(day), F.col(published), open_hour=open_hour)
    if ended is not None:
        allowed = F.col(ended) | allowed
        closing = F.when(F.col(ended), F.lit(END_OF_FEED).cast("timestamp")).otherwise(closing)
    legal = publications.filter(allowed).select(
        closing.alias("gate_closes"), F.col(day), F.col(unit), F.col(value), F.col(published), F.col(tie_break)
    )
    pick = F.min_by if gate is Gate.FIRST_BEFORE_DAY else F.max_by
    chosen = pick(F.struct(value, published), F.struct(published, tie_break))
    return (
        legal.withWatermark("gate_closes", horizon)
        .groupBy("gate_closes", day, unit)
        .agg(chosen.alias("_row"))
        .select(day, unit, F.col(f"_row.{value}").alias(value), F.col(f"_row.{published}").alias(published))
    )


def live_business_days(events: DataFrame, *, time: str, keys: Sequence[str], aggregates: Sequence[Column],
                       start_hour: int = 5, lateness: str = "1 hour", ended: str | None = None) -> DataFrame:
    """Tumbling business-day totals, final once ``lateness`` has passed or a row with ``ended`` true has come."""
    opened = F.window(time, "1 day", "1 day", f"{start_hour} hours")
    clock = event_time(F.col(time))
    if ended is not None:
        clock = F.when(F.col(ended), F.lit(END_OF_FEED).cast("timestamp")).otherwise(clock)
    return (
        events.withColumn(time, clock)
        .withWatermark(time, lateness)
        .groupBy(opened.alias("w"), *keys)
        .agg(*aggregates)
        .withColumn("business_day", F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int")))
        .drop("w")
    )


def append_latest(path: str, *, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: a micro-batch leaves its latest row per key under its own id.

    Replaying a batch overwrites its own folder only, so the log is exact after a restart.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, keys, order=order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_state(spark: SparkSession, path: str, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key over all batches written so far."""
    return latest_per_key(spark.read.parquet(path).drop("batch"), keys, order=order)


def compact(spark: SparkSession, path: str, target: str, *, keys: Sequence[str], order: Sequence[str]) -> None:
    """Write the current state as the first batch of a new log."""
    current_state(spark, path, keys=keys, order=order).write.mode("overwrite").parquet(f"{target}/batch=-1")
