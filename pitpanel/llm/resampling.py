"""Importance resampling towards a target distribution, ranked by parallel sorting by regular sampling.

Features are the runs of 1 to ``max_words`` consecutive words of a text; each falls into one of
``n_buckets`` buckets by crc32. Counts over all raw texts and over all target texts give every
bucket a gain, the floored log ratio of the two smoothed multinomials in thousandths; the gains
are one array that tasks look features up in. A document's weight is the sum of its features'
gains and its score adds Gumbel noise from a hash of its id, so that the highest scores are a
draw without replacement in proportion to exp(weight / 1000).

Ranks come from parallel sorting by regular sampling. Every task of the stored scores sorts its
run and gives every ``step``-th row of it (some rows a segment over all runs, at most
``most_segments`` times ``samples`` in all); the samples, sorted, give regular splitters; rows go to the segment between two splitters;
a segment's rows are merged in order and numbered; and the sizes of the segments before it
are added. Rows are ordered by score, id and their place in the stored table, so no two are equal and
a value that very many rows have is split like any other.

Defined results: a null text has no words, so no features, weight 0 and no rank; a null id
counts as an empty one in the hash and comes last among equal scores; repeated rows stay, a row
each, with a rank each; without target texts all target counts are 0; other columns are not
read. Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pitpanel.llm.common import map_rows
from pitpanel.session import cut_lineage

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words that remember their bucket, a task at a time.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Draw:
    max_words: int = 1
    n_buckets: int = 10_000
    seed: int = 2024
    min_words: int = 20
    #: Percent of the documents with enough words that are drawn, rounded down.
    percent: int = 10
    #: Rows of a segment, about, and segments at most; runs give ``samples`` rows a segment to choose splitters from.
    segment_rows: int = 500_000
    least_segments: int = 64
    most_segments: int = 4096
    samples: int = 32


def features(text: str | None, max_words: int) -> tuple[int, list[str]]:
    """(number of words, runs of 1 to ``max_words`` words, joined by a space)."""
    words = WORD.findall((text or "").translate(LOWER))
    out = list(words)
    for n in range(2, max_words + 1):
        out += [" ".join(words[k:k + n]) for k in range(len(words) - n + 1)]
    return len(words), out


class Buckets(dict):
    """Feature to bucket, remembered."""

    def __init__(self, n_buckets: int):
        super().__init__()
        self.n_buckets = n_buckets

    def __missing__(self, feature: str) -> int:
        from zlib import crc32

        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = crc32(feature.encode("utf-8")) % self.n_buckets
        return found

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def bucket_counts(texts: DataFrame, draw: Draw, text_col: str = "text") -> np.ndarray:
    """Occurrences in each bucket over all rows: a count a task and bucket is shuffled, ``n_buckets`` numbers are collected."""
    def run(batches):
        import pyarrow as pa

        buckets, counts = Buckets(draw.n_buckets), np.zeros(draw.n_buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts += np.bincount(buckets.of(features(text, draw.max_words)[1]), minlength=draw.n_buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["bucket", "n"])

    rows = texts.select(text_col).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(draw.n_buckets, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the two multinomials, each bucket counted once more than seen."""
    n, s, t = float(len(raw)), raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(ids: list, seed: int) -> np.ndarray:
    """floor(1000 Gumbel) by the first 8 hex digits of sha256 of ``seed:id``."""
    from hashlib import sha256

    h = np.array([int(sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16) for k in ids], float)
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)


def scored(docs: DataFrame, gains: np.ndarray, draw: Draw, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, run, place): ``run`` and ``place`` number the rows of each task."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def start():
        from pyspark import TaskContext

        buckets, run, place = Buckets(draw.n_buckets), TaskContext.get().partitionId(), 0

        def step(columns):
            nonlocal place
            ids, texts = columns
            words, sizes, weights = [], [], []
            for text in texts:
                n, found = features(text, draw.max_words)
                words.append(n)
                sizes.append(len(found))
                weights.append(int(shared.value[buckets.of(found)].sum()))
            place += len(ids)
            return [ids, words, sizes, weights, (np.array(weights, np.int64) + noise(ids, draw.seed)).tolist(), [run] * len(ids),
                    list(range(place - len(ids), place))]

        return step

    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint, score bigint, "
                    "run bigint, place bigint", start)


def order(id_col: str) -> list:
    return [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("run"), F.col("place")]


def regular_splitters(rows: DataFrame, n: int, draw: Draw, id_col: str) -> list[tuple]:
    """Keys (-score, id is null, id, run, place) that cut the ``n`` rows into segments of about equal size. Eager."""
    segments = min(draw.most_segments, max(draw.least_segments, n // draw.segment_rows + 1))
    step = max(1, n // (segments * draw.samples))

    def sample(batches):
        import pyarrow as pa

        at = 0
        for batch in batches:  # the middle of every ``step`` rows of the run
            yield batch.take(pa.array(range((step // 2 - at) % step, batch.num_rows, step), pa.int64()))
            at += batch.num_rows

    runs = rows.select("score", id_col, "run", "place").sortWithinPartitions(*order(id_col))
    found = runs.mapInArrow(sample, runs.schema).collect()
    keys = sorted((-s, d is None, d, r, p) for s, d, r, p in found)
    segments = min(segments, max(1, len(keys)))
    return [keys[len(keys) * k // segments] for k in range(1, segments)]


def ranked(rows: DataFrame, draw: Draw, id_col: str) -> DataFrame:
    """``rows`` with ``position``, 1 for the highest score. Eager."""
    keys = regular_splitters(rows, rows.count(), draw, id_col)

    def deal(batches):
        from bisect import bisect_right

        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("score", id_col, "run", "place")]
            found = [bisect_right(keys, (-s, d is None, d, r, p)) for s, d, r, p in zip(*columns, strict=True)]
            yield batch.append_column("segment", pa.array(found, pa.int32()))

    dealt = StructType([*rows.schema, StructField("segment", IntegerType())])
    exchanged = cut_lineage(rows.mapInArrow(deal, dealt))
    sizes = {r["segment"]: r["n"] for r in exchanged.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(len(keys) + 1)])])

    def number(batches):
        import pyarrow as pa

        seen: dict[int, int] = {}
        for batch in batches:
            own = batch.column("segment").to_numpy()
            out = np.zeros(len(own), np.int64)
            for k in np.unique(own).tolist():
                mine = np.flatnonzero(own == k)
                at = seen.get(k, 0)
                out[mine] = before[k] + at + 1 + np.arange(len(mine))
                seen[k] = at + len(mine)
            yield batch.append_column("position", pa.array(out))

    merged = exchanged.repartition("segment").sortWithinPartitions("segment", *order(id_col))
    return merged.mapInArrow(number, StructType([*dealt, StructField("position", LongType())]))


def resample(docs: DataFrame, target: DataFrame, *, draw: Draw = Draw(), id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; a null rank is undrawn. Eager: writes scores to the shared folder."""
    gains = bucket_gains(bucket_counts(docs, draw, text_col), bucket_counts(target, draw, target_col))
    rows = cut_lineage(scored(docs, gains, draw, id_col, text_col))
    enough = rows.filter(F.col("n_words") >= draw.min_words)
    placed = ranked(enough, draw, id_col)
    drawn = enough.count() * draw.percent // 100
    columns = [id_col, "n_features", "weight", "score"]
    return placed.select(*columns, F.when(F.col("position") <= drawn, F.col("position")).alias("rank")).unionByName(
        rows.filter(F.col("n_words") < draw.min_words).select(*columns, F.lit(None).cast("bigint").alias("rank")))
