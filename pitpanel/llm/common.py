"""Helpers shared by the operators: table access, text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: str,
             start: Callable[[], Callable[[list[list[Any]]], list[list[Any]]]]) -> DataFrame:
    """Arrow batches in and out: ``start()`` runs once a task and gives a function from the
    input columns (as lists) to the output columns (as lists, one value a row)."""
    spark = df.sparkSession
    out = spark.createDataFrame([], schema).schema

    def run(batches: Iterator) -> Iterable:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, step = to_arrow_schema(out), start()
        for batch in batches:
            found = step([batch.column(i).to_pylist() for i in range(batch.num_columns)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, type=field.type) for values, field in zip(found, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def quoted(name: str) -> str:
    """The column of just this name, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def append_columns(df: DataFrame, inputs: list[str], schema: str,
                   start: Callable[[], Callable[[list[list[Any]]], list[list[Any]]]]) -> DataFrame:
    """As ``map_rows``, but keeps every column of ``df``; one whose name ``schema`` takes again is replaced."""
    from pyspark.sql.types import StructField, StructType

    new = df.sparkSession.createDataFrame([], schema).schema
    names = {field.name for field in new}
    kept = [name for name in df.columns if name not in names]
    taken = [*kept, *(name for name in inputs if name in names)]
    out = StructType([df.schema[name] for name in kept] + list(new))
    # Columns go by number, as their names may hold dots.
    numbered = StructType([StructField(f"c{k}", field.dataType) for k, field in enumerate(out)])
    places = [taken.index(name) for name in inputs]

    def run(batches: Iterator) -> Iterable:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, step = to_arrow_schema(numbered), start()
        for batch in batches:
            found = step([batch.column(k).to_pylist() for k in places])
            columns = batch.columns[:len(kept)]
            columns += [pa.array(values, type=arrow.field(len(kept) + k).type) for k, values in enumerate(found)]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    source = df.select(*[F.col(quoted(name)).alias(f"c{k}") for k, name in enumerate(taken)])
    return source.mapInArrow(run, numbered).toDF(*out.names)


#: Bits of the filter that ``listed_bits`` brings to the tasks: eight for each key, within these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def listed_bits(listed: DataFrame) -> tuple[int, Any]:
    """(number of bits, broadcast bitmap) of the bigint keys in the one column of ``listed``; bit k: a key that leaves k.

    Its size follows the number of keys up to 16 MB; beyond, it lets more other keys through, and the
    join that follows it drops them. Eager.
    """
    import numpy as np

    key = F.col(listed.columns[0])
    n = listed.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n).bit_length()))
    spot = F.pmod(key, F.lit(size)) + 1
    rows = (listed.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect())
    bits = np.zeros(size, bool)
    for row in rows:
        part = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")[:size]
        bits[(row["part"] - 1) * len(part):row["part"] * len(part)] = part
    return size, listed.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))


def in_bits(keys, size: int, table_):
    """Whether the numpy keys may be listed."""
    at = keys & (size - 1)
    return (table_[at >> 3] >> (at & 7).astype("uint8")) & 1 == 1


def perhaps_listed(listed: DataFrame) -> Callable[[str], Column]:
    """A test whether a bigint column may be in the one column of ``listed``: true for all that are, for few that are not.

    So a join of a few rows with a wide table need not shuffle the wide one whole. Eager in the bitmap.
    """
    size, bits = listed_bits(listed)

    def found(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bits(keys.to_numpy(), size, bits.value))

    test = F.pandas_udf(found, "boolean")
    return lambda key: test(F.coalesce(F.col(key), F.lit(0)))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores put before it until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name
