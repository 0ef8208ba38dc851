"""Benchmark decontamination by winnowing, in DataFrame operations only.

A *window* is ``window`` consecutive words of a benchmark item, or the whole of a shorter item.
Of the ``gram``-word hashes inside a window the smallest is its fingerprint; sliding the same
window over a document gives the document's fingerprints. Two equal windows have equal
fingerprints, so joining the fingerprints misses no shared window. Hits are then extended: the
document windows with a joined fingerprint are compared with the items' windows word for word.
Items shorter than a window are fingerprinted whole, against all document spans of that many words.

Texts are known by two 64-bit hashes of their content, so copies share one result. Nothing is
broadcast by hint; the planner does it for sides it measures as small. Texts are shuffled once,
to fetch those with a fingerprint hit.

Defined results: a null text has no words and is clean; items without words match nothing; a
null item id contaminates but is not listed; repeated item ids count once; repeated document
rows and null document ids stay, a row each; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.session import cut_lineage


def without(others: str) -> str:
    """Runs of characters that are not among ``others``, each listed by itself: Java then looks a character up
    in one table, where it would try range after range."""
    return "[^" + "".join(f"\\x{ord(c):02X}" for c in others) + "]+"


#: ASCII digits and lower-case letters, and everything beyond ASCII; the same with upper-case letters.
WORD = without("".join(c for c in map(chr, range(128)) if not (c.isdigit() or c.islower())))
CASED_WORD = without("".join(c for c in map(chr, range(128)) if not c.isalnum()))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["_key_a", "_key_b"]


def words_of(text: str) -> Column:
    """Words after lower-casing A-Z; text all in ASCII takes the quicker built-in."""
    c = F.col(text)
    lowered = F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def content_key(text: str) -> dict[str, Column]:
    return {KEY[0]: F.xxhash64(F.col(text)), KEY[1]: F.xxhash64(F.lit(1), F.col(text))}


def neighbours(array: Column, i: Column, n: int) -> list[Column]:
    """Elements i to i + n - 1; in a lambda, slice() would copy the whole array each time."""
    return [F.get(array, i + k) for k in range(n)]


def gram_hashes(words: str, gram: int) -> Column:
    """Hash of every run of ``gram`` words, in order."""
    w = F.col(words)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - gram), lambda i: F.xxhash64(*neighbours(w, i, gram)))
    return F.when(F.size(w) >= gram, runs).otherwise(F.array().cast("array<bigint>"))


def sliding_minima(hashes: str, width: int) -> Column:
    """Smallest of every ``width`` neighbouring hashes, in order."""
    h = F.col(hashes)
    if width == 1:
        return h
    minima = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.least(*neighbours(h, i, width)))
    return F.when(F.size(h) >= width, minima).otherwise(F.array().cast("array<bigint>"))


def fingerprinted(texts: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """``texts`` with ``_words`` and ``_prints``: the fingerprint of every span of ``length`` words."""
    gram = min(gram, length)
    return (texts.withColumn("_words", words_of(text)).withColumn("_hashes", gram_hashes("_words", gram))
            .withColumn("_prints", sliding_minima("_hashes", length - gram + 1)).drop("_hashes"))


def spans_at(starts: Column, length: int) -> Column:
    """(start, words joined) at each of ``starts``."""
    w = F.col("_words")
    return F.transform(starts, lambda i: F.struct(i.alias("_start"), F.concat_ws(" ", *neighbours(w, i, length)).alias("_span"),
                                                  F.get(F.col("_prints"), i).alias("_print")))


def item_windows(benchmark: DataFrame, window: int, gram: int, item_col: str, text_col: str) -> DataFrame:
    """(item, length, span, print): every window of every item."""
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(text_col).alias("_text"))
    items = items.withColumn("_length", F.least(F.size(words_of("_text")), F.lit(window)))
    parts = []
    for length in range(1, window + 1):
        found = fingerprinted(items.filter(F.col("_length") == length), "_text", length, gram)
        everywhere = spans_at(F.sequence(F.lit(0), F.size("_prints") - 1), length)
        parts.append(found.select("_item", F.lit(length).alias("_length"), F.explode(everywhere).alias("_at"))
                     .select("_item", "_length", "_at._span", "_at._print"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contaminated_spans(docs: DataFrame, windows: DataFrame, lengths: list[int], gram: int, text_col: str) -> DataFrame:
    """(key, start, length, span) of the document windows that are item windows, a row for each place in a text."""
    texts = docs.select(F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull()).withColumns(content_key("_text"))
    spans = windows.select("_length", "_span", "_print").distinct()
    prints = spans.select("_length", "_print").distinct()
    hits = None
    for length in lengths:
        mine = (fingerprinted(texts, "_text", length, gram)
                .select(*KEY, F.explode(F.array_distinct("_prints")).alias("_print"))
                .join(prints.filter(F.col("_length") == length), "_print"))
        hits = mine if hits is None else hits.unionByName(mine)
    hits = cut_lineage(hits.groupBy(*KEY, "_length").agg(F.collect_set("_print").alias("_hit")))
    keys = hits.select(*KEY).distinct()
    hit_texts = cut_lineage(texts.join(keys, KEY, "left_semi").dropDuplicates(KEY))
    out = None
    for length in lengths:
        found = fingerprinted(hit_texts, "_text", length, gram).join(hits.filter(F.col("_length") == length), KEY)
        starts = F.filter(F.sequence(F.lit(0), F.size("_prints") - 1),
                          lambda i: F.array_contains(F.col("_hit"), F.get(F.col("_prints"), i)))
        found = found.select(*KEY, F.explode(spans_at(starts, length)).alias("_at")).select(*KEY, "_at._start", "_at._span")
        part = found.join(spans.filter(F.col("_length") == length).select("_span", "_length").distinct(), "_span")
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, gram: int = 5, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and the array ``items``.

    Eager in part: writes the item windows, the hits and the texts hit to the shared folder and
    brings the window lengths (at most ``window`` numbers) to the driver.
    """
    windows = cut_lineage(item_windows(benchmark, window, gram, item_col, item_text_col))
    lengths = sorted(r["_length"] for r in windows.select("_length").distinct().collect()) or [window]
    found = cut_lineage(contaminated_spans(docs, windows, lengths, gram, text_col))
    covered = F.flatten(F.transform("_places", lambda p: F.sequence(p["_start"], p["_start"] + p["_length"] - 1)))
    words = (found.groupBy(*KEY).agg(F.collect_set(F.struct("_start", "_length")).alias("_places"))
             .select(*KEY, F.size(F.array_distinct(covered)).cast("bigint").alias("_n_hit")))
    items = (found.select(*KEY, "_span").distinct()
             .join(windows.select("_span", F.col("_item").cast("string").alias("_item")).distinct(), "_span")
             .groupBy(*KEY).agg(F.array_sort(F.collect_set("_item")).alias("_items")))
    results = words.join(items, KEY, "left")
    new = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")
    kept = [c for c in docs.columns if c not in new]
    every_word = F.regexp_count(F.col(text_col), F.lit(CASED_WORD))
    n_words = F.coalesce(every_word, F.lit(0)).cast("bigint")
    listed = F.coalesce("_items", F.array().cast("array<string>"))
    n_hit = F.coalesce("_n_hit", F.lit(0).cast("bigint"))
    return (docs.select(*kept, n_words.alias("n_words")).withColumns(content_key(text_col)).join(results, KEY, "left")
            .select(*kept, "n_words", n_hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                    listed.alias("items")))
