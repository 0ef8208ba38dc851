"""Quality rules: log-likelihood ratio of hashed n-grams between trusted and raw text.

Words and word pairs fall into ``n_buckets`` hash buckets. One pass over all documents counts
the buckets of the raw corpus and of the trusted documents; the two smoothed multinomials give
a log ratio for each bucket. A document's ratio is the mean over its n-grams, so length does
not matter, and every document is compared with the same fixed threshold.

The trusted target is every document that carries a trust label; the raw counts cover all documents.
A bitmap of the labelled ids keeps most other texts out of the join that finds the trusted ones. What
comes to the driver is the table of log ratios: ``n_buckets`` numbers, whatever the corpus.

Base rules: too few words, or too many words inside repeated windows of three.

Defined results: a null or blank text has no words, fails the base rules and gets a ratio of 0;
without trusted documents every ratio is 0 and the base rules alone decide; repeated rows and
null ids stay, a row each; other columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import append_columns, map_rows, perhaps_listed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Odd multipliers of the bucket hash.
FIRST, SECOND, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Words that remember their hash, a task at a time.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Mean log ratio that a document needs.
    min_ratio: float = -0.13
    n_buckets: int = 1 << 16
    smoothing: float = 0.5


class Hasher:
    """Buckets of a text's words and word pairs."""

    def __init__(self, n_buckets: int):
        self.shift = np.uint64(64 - (n_buckets.bit_length() - 1))
        self.known: dict[str, int] = {}

    def buckets(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = crc32(word.encode("utf-8"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) + np.uint64(1)
        pairs = (h[:-1] * FIRST) ^ (h[1:] * SECOND)
        return ((np.concatenate([h * FIRST, pairs * MIX]) * MIX) >> self.shift).astype(np.int64)


def repeated_words(words: list[str]) -> int:
    """Words inside windows of three words that occur more than once."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    if n < 2_000_000:  # three numbers fit 63 bits
        windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * n + ids[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[which] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:len(again) + k] |= again
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def log_ratios(docs: DataFrame, trusted: DataFrame, limits: Limits, id_col: str = "doc_id",
               text_col: str = "text") -> np.ndarray:
    """Log ratio of each bucket between trusted and raw text; ``trusted`` has the ids. Eager."""
    ids = trusted.select(F.col(id_col).alias("trusted_id")).filter(F.col("trusted_id").isNotNull()).distinct()
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    perhaps = F.coalesce(perhaps_listed(ids.select(F.xxhash64("trusted_id")))("_key"), F.lit(False))
    named = named.withColumn("_key", F.xxhash64("_id")).withColumn("_perhaps", perhaps & F.col("_id").isNotNull())
    # Only rows that may be labelled are shuffled, the same way at every size.
    flagged = (named.filter("_perhaps").join(ids.hint("merge"), F.col("_id") == F.col("trusted_id"), "left")
               .select("_text", F.col("trusted_id").isNotNull().alias("trusted"))
               .unionByName(named.filter("NOT _perhaps").select("_text", F.lit(False).alias("trusted"))))
    n = limits.n_buckets

    def run(batches):
        import pyarrow as pa

        hasher, counts = Hasher(n), np.zeros((2, n), np.int64)
        for batch in batches:
            for text, is_trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = hasher.buckets(WORD.findall(text or ""))
                np.add.at(counts[0], found, 1)
                if is_trusted:
                    np.add.at(counts[1], found, 1)
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])],
                                         names=["bucket", "raw", "trusted"])

    rows = flagged.mapInArrow(run, "bucket bigint, raw bigint, trusted bigint").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, good = np.zeros(n), np.zeros(n)
    raw[rows["bucket"].to_numpy(np.int64)] = rows["raw"]
    good[rows["bucket"].to_numpy(np.int64)] = rows["trusted"]
    if not good.sum():
        return np.zeros(n, np.float32)
    p = (good + limits.smoothing) / (good.sum() + limits.smoothing * n)
    q = (raw + limits.smoothing) / (raw.sum() + limits.smoothing * n)
    return np.log(p / q).astype(np.float32)


def judge(docs: DataFrame, ratios: np.ndarray, limits: Limits, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio and kept."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def start():
        hasher = Hasher(limits.n_buckets)

        def step(columns):
            out = [[] for _ in range(8)]
            for text in columns[0]:
                text = text or ""
                words = WORD.findall(text)
                n, again = len(words), repeated_words(words)
                failed = n < limits.min_words or 100 * again > limits.max_repeat_percent * n
                found = table.value[hasher.buckets(words)] if words else np.zeros(1)
                ratio = round(float(found.mean(dtype=np.float64)), 6)
                row = (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines(text), again, failed, ratio,
                       not failed and ratio >= limits.min_ratio)
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            return out

        return step

    return append_columns(docs, [text_col], "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                          "n_repeat_words bigint, base_failed boolean, ratio double, kept boolean", start)


def apply_rules(docs: DataFrame, trusted: DataFrame, *, limits: Limits = Limits(), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Fit the two multinomials, then judge every document. Eager in the first step."""
    return judge(docs, log_ratios(docs, trusted, limits, id_col, text_col), limits, text_col)
