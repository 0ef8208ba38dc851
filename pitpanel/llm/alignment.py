"""Cross-tokenizer alignment by products of sparse incidence matrices.

A text is encoded by two tokenizers, A (byte-level BPE, a space put before the text) and B
(SentencePiece, which puts one itself), so that both cover the same bytes. Token-byte incidence
matrices in compressed rows (``CSR``) have a row for each token and an entry for each of its
bytes; the row products of Gustavson of A and B transposed give the overlap links, an entry for
each pair of tokens with a byte in common, its value the number of such bytes. Offsets where
tokens of both end cut the tokens into groups; the product of the token-group incidence matrices
gives the shared-group links. Many documents share one product, as their bytes have numbers
of their own.

How often two vocabulary entries are linked is counted over all documents. Encoding is done once:
every document's distinct pairs and their times go to a table on the shared folder, tasks count
pairs over their documents before the shuffle, and a second pass over the stored pairs looks the
counts up. The ``hot_pairs`` most frequent pairs are looked up in a shared array; a document's
other pairs are exploded and joined, so the counts of a pair are exact at any vocabulary and
only rare pairs are shuffled.

Defined results: a text that is null, empty, or whose tokens do not join to the bytes of space
and text (a text with U+2581, say) has no tokens: zeros and an empty digest; repeated rows and
null ids stay, a row each, and count each; special strings in a text are plain text; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.byte_bpe import ByteLevelBPE
from pitpanel.llm.common import map_rows
from pitpanel.llm.token_counts import safe_pieces
from pitpanel.session import cut_lineage

#: Bytes of text that one product takes, about, and entries that a step of a product holds.
BATCH_BYTES, STEP_ENTRIES = 1 << 19, 1 << 21
#: Longer texts are encoded in pieces cut at safe spaces.
PIECE_CHARS = 1 << 15
#: Pairs that a task counts before it passes them on.
HELD_PAIRS = 1_000_000


class CSR(NamedTuple):
    """Sparse matrix by rows: entries ``ptr[i]`` to ``ptr[i + 1]`` of ``col`` and ``val`` are row i's."""

    ptr: np.ndarray
    col: np.ndarray
    val: np.ndarray
    width: int


def token_bytes(lengths: np.ndarray) -> CSR:
    """Incidence of tokens that lie one after the other and their bytes."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    return CSR(np.concatenate([[0], ends]), np.arange(n), np.ones(n, np.int64), n)


def token_groups(groups: np.ndarray, n_groups: int) -> CSR:
    """Incidence of tokens and the one group that each is in."""
    return CSR(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), n_groups)


def transposed(m: CSR) -> CSR:
    rows = np.repeat(np.arange(len(m.ptr) - 1), np.diff(m.ptr))
    order = np.argsort(m.col, kind="stable")
    ptr = np.concatenate([[0], np.cumsum(np.bincount(m.col, minlength=m.width))])
    return CSR(ptr, rows[order], m.val[order], len(m.ptr) - 1)


def entries_before(a: CSR, b: CSR) -> np.ndarray:
    """Entries of rows of ``b`` that the rows of ``a`` before each take up (the symbolic step of the product)."""
    return np.concatenate([[0], np.cumsum(np.diff(b.ptr)[a.col])])[a.ptr]


def product(a: CSR, b: CSR) -> CSR:
    """a b by Gustavson's rule: row i is the sum of the rows k of ``b``, times a[i, k], over the entries of row i of ``a``."""
    before = entries_before(a, b)
    n, sizes, cols, vals, at = len(a.ptr) - 1, [], [], [], 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(before, before[at] + STEP_ENTRIES, side="right")) - 1)
        low, high = a.ptr[at], a.ptr[end]
        taken = a.col[low:high]
        width = b.ptr[taken + 1] - b.ptr[taken]
        source = np.repeat(b.ptr[taken] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        row = np.repeat(np.repeat(np.arange(end - at), np.diff(a.ptr[at:end + 1])), width)
        key, val = row * b.width + b.col[source], np.repeat(a.val[low:high], width) * b.val[source]
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, val = key[order], val[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        cols.append(key[first] % b.width)
        vals.append(np.add.reduceat(val, first) if len(first) else val)
        sizes.append(np.bincount(key[first] // b.width, minlength=end - at))
        at = end
    empty = [np.zeros(0, np.int64)]
    return CSR(np.concatenate([[0], np.cumsum(np.concatenate(sizes or empty))]), np.concatenate(cols or empty), np.concatenate(vals or empty), b.width)


def row_numbers(m: CSR) -> np.ndarray:
    return np.repeat(np.arange(len(m.ptr) - 1), np.diff(m.ptr))


class Tokenizers:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece

        self.a = ByteLevelBPE(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        n_a = max(self.a.tokens) + 1
        self.a_bytes = [self.a.tokens.get(k, b"") for k in range(n_a)]
        pieces = [(self.b.id_to_piece(k), self.b.is_byte(k)) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if one else p.replace("▁", " ").encode("utf-8") for p, one in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B; none if one of them does not give the bytes of space and text back."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        pieces = safe_pieces(text, PIECE_CHARS)
        a = np.concatenate([self.a.plain(" " + piece) for piece in pieces]).astype(np.int64)
        b = np.concatenate([np.array(ids, np.int64) for ids in self.b.encode(pieces, num_threads=1)])
        whole = (" " + text).encode("utf-8")
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return none, none
        return a, b


class Aligned(NamedTuple):
    """Documents aligned together: ids, token counts, groups of the tokens (numbered over all), groups of each document."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: np.ndarray
    overlap: CSR

    def shared_groups(self) -> tuple[CSR, CSR]:
        """Factors whose product has the shared-group links."""
        n = int(self.n_groups.sum())
        return token_groups(self.group_a, n), transposed(token_groups(self.group_b, n))


def align(encoded: list[tuple[np.ndarray, np.ndarray]], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Overlap links and groups of documents whose token bytes agree."""
    a, b = (np.concatenate([e[k] for e in encoded]) if encoded else np.zeros(0, np.int64) for k in (0, 1))
    n_a, n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
    size_a, size_b = a_sizes[a], b_sizes[b]
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    owner = np.repeat(np.arange(len(encoded)), n_a)
    last = np.flatnonzero(np.append(group_a[1:] != group_a[:-1], True)) if len(a) else np.zeros(0, np.int64)
    n_groups = np.bincount(owner[last], minlength=len(encoded))
    return Aligned(a, b, n_a, n_b, group_a, group_b, n_groups, product(token_bytes(size_a), transposed(token_bytes(size_b))))


def group_texts(found: Aligned, names: tuple[list[np.ndarray], list[np.ndarray]]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document; ``names``: ids of A and of B as text, with ``,`` and with the mark after a group."""
    ends_a = np.append(found.group_a[1:] != found.group_a[:-1], True) if len(found.a) else np.zeros(0, bool)
    ends_b = np.append(found.group_b[1:] != found.group_b[:-1], True) if len(found.b) else np.zeros(0, bool)
    parts = np.concatenate([np.where(ends_a, names[0][1][found.a], names[0][0][found.a]), np.where(ends_b, names[1][1][found.b], names[1][0][found.b])])
    order = np.argsort(np.concatenate([2 * found.group_a, 2 * found.group_b + 1]), kind="stable")
    parts = parts[order].tolist()
    ends = np.cumsum(found.n_a + found.n_b).tolist()
    return ["".join(parts[a:b])[:-1] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def batches_by_bytes(texts: list[str | None]):
    """Numbers of the first and one past the last text of batches of about BATCH_BYTES characters."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_BYTES:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


@dataclass(frozen=True)
class Files:
    """Byte-level BPE file (A) and SentencePiece model (B)."""

    a: str
    b: str


class PairCounts:
    """Counts of pair keys within a task; what is held is passed on beyond HELD_PAIRS."""

    def __init__(self):
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        all_keys, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        sums = np.zeros(len(all_keys), np.int64)
        np.add.at(sums, place, np.concatenate([self.times, times]))
        self.keys, self.times = all_keys, sums
        return self.flush() if len(all_keys) > HELD_PAIRS else None

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.keys, self.times
        self.__init__()
        return out


def encoded_documents(docs: DataFrame, files: Files, id_col: str, text_col: str) -> DataFrame:
    """A row for each document (its counts, digest, and its distinct pairs ``keys`` with ``times``), and rows
    (key, n) with the links of a pair over the documents of a task."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_group_links bigint, groups_sha256 string, "
              "keys binary, times binary, key bigint, n bigint")
    source = docs.select(F.col(id_col).alias("id"), text_col)
    out = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, known, counts = to_arrow_schema(out), Tokenizers(files.a, files.b), PairCounts()
        row, n_b = TaskContext.get().partitionId() << 40, len(known.b_bytes)
        names = tuple(tuple(np.array([f"{k}{mark}" for k in range(n)], object) for mark in marks)
                      for n, marks in ((len(known.a_bytes), ",|"), (n_b, ",;")))

        def pair_rows(found):
            keys, times = found
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(keys), f.type) for f in list(arrow)[:10]), pa.array(keys), pa.array(times)], schema=arrow)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in batches_by_bytes(texts):
                found = align([known.encode(text) for text in texts[low:high]], known.a_sizes, known.b_sizes)
                left = row_numbers(found.overlap)
                owner = np.repeat(np.arange(high - low), found.n_a)
                per_doc = np.bincount(owner[left], minlength=high - low)
                shared = np.diff(entries_before(*found.shared_groups()))
                group_links = np.bincount(owner, weights=shared, minlength=high - low).astype(np.int64)
                keys = found.a[left] * n_b + found.b[found.overlap.col]
                sums = [np.unique(keys[e - n:e], return_counts=True) for e, n in zip(np.cumsum(per_doc).tolist(), per_doc.tolist(), strict=True)]
                digests = [sha256(text.encode()).hexdigest() if text else "" for text in group_texts(found, names)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(np.arange(row, row + high - low)), pa.array(found.n_a), pa.array(found.n_b),
                     pa.array(found.n_groups), pa.array(per_doc), pa.array(group_links), pa.array(digests, arrow.field(7).type),
                     pa.array([k.astype("<i8").tobytes() for k, _ in sums], arrow.field(8).type),
                     pa.array([t.astype("<i4").tobytes() for _, t in sums], arrow.field(9).type),
                     pa.nulls(high - low, pa.int64()), pa.nulls(high - low, pa.int64())], schema=arrow)
                row += high - low
                if len(keys):
                    full = counts.add(np.concatenate([k for k, _ in sums]), np.concatenate([t for _, t in sums]))
                    if full:
                        yield pair_rows(full)
        yield pair_rows(counts.flush())

    return source.mapInArrow(run, out)


def hot_level(pairs: DataFrame, hot_pairs: int) -> tuple[int, bool]:
    """Least eighth of a power of two such that at most ``hot_pairs`` pairs have so high a count, and whether these are all. Eager."""
    level = F.floor(F.log2("count") * 8).cast("bigint")
    rows = pairs.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, out = 0, None
    for row in sorted(rows, key=lambda r: -r["level"]):
        total += row["n"]
        if total > hot_pairs:
            return (row["level"] + 1 if out is None else out), False
        out = row["level"]
    return out or 0, True


def alignments(docs: DataFrame, files: Files, *, hot_pairs: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links) of every document.

    Eager: writes the distinct pairs of every document to the shared folder; the counts of at most
    ``hot_pairs`` pairs and one count for each entry of B come to the driver.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=files.b).get_piece_size()
    stored = cut_lineage(encoded_documents(docs, files, id_col, text_col))
    pairs = cut_lineage(stored.filter("key is not null").groupBy("key").agg(F.sum("n").alias("count")))
    best = np.zeros(n_b, np.int64)
    for row in pairs.groupBy((F.col("key") % n_b).alias("b")).agg(F.max("count").alias("count")).collect():
        best[row["b"]] = row["count"]
    level, whole = hot_level(pairs, hot_pairs)
    hot = pairs.filter(F.floor(F.log2("count") * 8) >= level).toPandas()
    order = np.argsort(hot["key"].to_numpy(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(
        (hot["key"].to_numpy(np.int64)[order], hot["count"].to_numpy(np.int64)[order], best))
    rows = stored.filter("row is not null")
    names = ["id", "row", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256"]
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def start():
        hot_keys, hot_counts, highest = shared.value

        def step(columns):
            keys = np.frombuffer(b"".join(columns[-2]), "<i8")
            times = np.frombuffer(b"".join(columns[-1]), "<i4").astype(np.int64)
            sizes = [len(x) // 8 for x in columns[-2]]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(hot_keys, keys), max(len(hot_keys) - 1, 0))
            known = hot_keys[at] == keys if len(hot_keys) else np.zeros(len(keys), bool)
            count = np.where(known, hot_counts[at] if len(hot_keys) else 0, 0)
            is_best = known & (count == highest[keys % n_b])
            n_best, sums = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(n_best, owner, times * is_best)
            np.add.at(sums, owner, times * count)
            cold = [[] for _ in sizes]
            for k in np.flatnonzero(~known).tolist():
                cold[owner[k]].append({"key": int(keys[k]), "times": int(times[k])})
            return [*columns[:-2], n_best.tolist(), sums.tolist(), cold]

        return step

    looked = map_rows(rows, [*names, "keys", "times"], schema + ", n_best bigint, count_sum bigint, cold array<struct<key bigint, times bigint>>", start)
    if not whole:
        looked = with_rare_pairs(cut_lineage(looked), pairs, best, n_b)
    return looked.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


def with_rare_pairs(looked: DataFrame, pairs: DataFrame, best: np.ndarray, n_b: int) -> DataFrame:
    """``looked`` with the pairs in ``cold`` added to n_best and count_sum, their counts joined by key."""
    highest = looked.sparkSession.createDataFrame([(k, int(n)) for k, n in enumerate(best.tolist()) if n], "entry bigint, highest bigint")
    rare = (looked.select("row", F.explode("cold").alias("pair")).select("row", "pair.*").join(pairs, "key")
            .join(highest, F.col("key") % n_b == F.col("entry")))
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("count") == F.col("highest"), F.col("times")).otherwise(0)).alias("more_best"),
                                   F.sum(F.col("count") * F.col("times")).alias("more_sum"))
    return (looked.join(sums, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))))


def links(docs: DataFrame, files: Files, *, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_place, a_id, b_place, b_id, n_shared): a row for each ``overlap`` link (bytes shared) or shared ``group`` link."""
    if kind not in ("overlap", "group"):
        raise ValueError(kind)
    source = docs.select(F.col(id_col).alias("id"), text_col)
    out = docs.sparkSession.createDataFrame(
        [], f"id {docs.schema[id_col].dataType.simpleString()}, a_place bigint, a_id bigint, b_place bigint, b_id bigint, n_shared bigint").schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, known = to_arrow_schema(out), Tokenizers(files.a, files.b)
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = align([known.encode(text)], known.a_sizes, known.b_sizes)
                m = found.overlap if kind == "overlap" else product(*found.shared_groups())
                left = row_numbers(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(len(left), k, np.int64))), pa.array(left), pa.array(found.a[left]), pa.array(m.col),
                     pa.array(found.b[m.col]), pa.array(m.val)], schema=arrow)

    return source.mapInArrow(run, out).withColumnRenamed("id", id_col)
