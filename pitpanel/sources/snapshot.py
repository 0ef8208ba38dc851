"""Snapshots of pulled tables with provenance, and restatement between pulls.

A pull of (dataset, vintage) is written once; ``refresh`` writes a new revision beside
the old, so readers of the old one are not disturbed and both can be compared.  The
provenance row is appended after the payload: a snapshot exists when its row does.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.operators.pointintime import vintage_diff

SCHEMA_VERSION = 1

PROVENANCE = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("source_urls", T.ArrayType(T.StringType())),
    T.StructField("request_count", T.LongType()),
    T.StructField("retrieved_at_utc", T.StringType()),
    T.StructField("licence", T.StringType()),
    T.StructField("vintage", T.StringType()),
    T.StructField("publication_lag", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("schema_version", T.LongType()),
    T.StructField("revision", T.LongType()),
])


def content_hash(df: DataFrame) -> DataFrame:
    """One row (rows, content_hash) that does not depend on row order or partitioning.

    The row hashes are summed, so equal rows count as often as they occur.
    """
    columns = [F.col(c) for c in sorted(df.columns)]
    total = F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), total.cast("string").alias("content_hash"))


def provenance(spark: SparkSession, root: str) -> DataFrame:
    """All provenance rows under ``root`` (empty when nothing was pulled)."""
    try:
        return spark.read.schema(PROVENANCE).parquet(f"{root}/provenance")
    except AnalysisException:
        return spark.createDataFrame([], PROVENANCE)


def latest_provenance(spark: SparkSession, root: str, dataset: str, vintage: str):
    """Row of the newest revision, or None."""
    rows = provenance(spark, root).filter((F.col("dataset") == dataset) & (F.col("vintage") == vintage))
    found = rows.orderBy(F.col("revision").desc()).limit(1).collect()
    return found[0] if found else None


def _payload(root: str, dataset: str, vintage: str, revision: int) -> str:
    return f"{root}/data/dataset={dataset}/vintage={vintage}/revision={revision}"


def read_snapshot(spark: SparkSession, root: str, dataset: str, vintage: str, revision: int | None = None) -> DataFrame:
    if revision is None:
        row = latest_provenance(spark, root, dataset, vintage)
        if row is None:
            raise LookupError(f"no snapshot of {dataset} {vintage}")
        revision = row["revision"]
    return spark.read.parquet(_payload(root, dataset, vintage, revision))


def snapshot(spark: SparkSession, root: str, *, dataset: str, vintage: str, pull: Callable[[], tuple[DataFrame, Sequence[str]]],
             licence: str, publication_lag: str, params: Mapping[str, str] | None = None, notes: str = "",
             refresh: bool = False) -> DataFrame:
    """Read (dataset, vintage), pulling and recording it first when absent or when refreshing.

    ``pull`` returns the table and the sources it came from.
    """
    known = latest_provenance(spark, root, dataset, vintage)
    if known is not None and not refresh:
        return read_snapshot(spark, root, dataset, vintage, known["revision"])
    frame, urls = pull()
    revision = 0 if known is None else known["revision"] + 1
    path = _payload(root, dataset, vintage, revision)
    frame.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    facts = content_hash(stored).first()
    row = (
        dataset, list(urls), len(urls), dt.datetime.now(tz=dt.timezone.utc).isoformat(timespec="seconds"),
        licence, vintage, publication_lag, facts["rows"], facts["content_hash"], notes,
        {k: str(v) for k, v in (params or {}).items()}, SCHEMA_VERSION, revision,
    )
    spark.createDataFrame([row], PROVENANCE).coalesce(1).write.mode("append").parquet(f"{root}/provenance")
    return stored


def restatements(spark: SparkSession, root: str) -> DataFrame:
    """Pulls of the same (dataset, vintage) whose content differs from the first pull."""
    rows = provenance(spark, root)
    firsts = rows.groupBy("dataset", "vintage").agg(F.min_by("content_hash", "revision").alias("first_hash"))
    return rows.join(firsts, ["dataset", "vintage"]).select(
        "dataset", "vintage", "revision", "rows", (F.col("content_hash") != F.col("first_hash")).alias("restated")
    )


def restated_rows(spark: SparkSession, root: str, dataset: str, vintage: str, *, keys: Sequence[str], values: Sequence[str],
                  old: int, new: int) -> DataFrame:
    """What changed between two revisions, per key."""
    return vintage_diff(read_snapshot(spark, root, dataset, vintage, old), read_snapshot(spark, root, dataset, vintage, new),
                        keys=keys, values=values)


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", order: Sequence[str] = ()) -> None:
    """Result tables as Parquet, CSV with header, or JSON; with ``order``, files in order and rows in order within."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
