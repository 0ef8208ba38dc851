"""Session settings the operators rely on, and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# UTC keeps TIMESTAMP and TIMESTAMP_NTZ interchangeable; AQE re-plans joins from
# measured sizes (run-time broadcast, skew split), so no operator has to guess.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "pitpanel", conf: dict[str, str] | None = None) -> SparkSession:
    """Session for a cluster: master, memory and parallelism stay with spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**BASE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(app_name: str = "pitpanel", cpus: int | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """One-JVM session for tests and the bench."""
    cores = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    local = {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **(conf or {}),
    }
    for key, value in local.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; make one up only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="pitpanel-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table on the shared checkpoint folder and read it back.

    A lost executor then costs no replay, and the planner sees the table's real size
    instead of estimates and constraints carried along from the steps before.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
