"""Best-fit packing by minimum bin slack.

1. Every text becomes token ids plus an end id; a longer list than the capacity is cut into
   full pieces, the first piece holding the rest. Tasks write the pieces to a table with a
   running number among the pieces of equal length in the task.
2. Only counts by length go on: a table of at most ``capacity`` rows. The planner opens bin
   after bin: the longest remaining length goes in first, and a subset-sum program over bitsets
   (bit s of an integer: sum s can be reached) finds the fullest combination of remaining
   lengths for the rest. A combination is taken as often as the counts allow before the next
   program runs, which gives the same bins as running it once per bin: what was fullest stays
   fullest while every length it uses is left. So there are at most ``capacity`` programs.
3. The number of a piece among all of its length (task totals plus the number in the task)
   says which bin and place it gets. No window or sort over the pieces is needed, so a length
   that a third of all documents have costs nothing extra.

Defined results: a null text is an empty one (one piece, the end id alone); repeated rows and
null ids give a set of pieces each; columns other than the two named are not read; an empty
table gives no rows. Equal pieces may swap places between runs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.llm.common import map_rows
from pitpanel.session import cut_lineage

#: Longer texts go to the tokenizers library itself, whose regular expressions don't recurse.
LONG_TEXT = 200_000
#: Tasks whose totals are added up in one window group.
BLOCK = 1024


class Encoder:
    """Texts to little-endian unsigned 32-bit ids of a byte-level BPE file of the tokenizers library.

    The file's vocabulary and pattern go to tiktoken, which gives the same ids in a quarter of the time.
    """

    #: The pattern of byte-level BPE, one end of text token kind aside (fixed value).
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in printable}
        byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(byte[c] for c in token): k for token, k in self.tokenizer.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        if len(text) > LONG_TEXT:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def cut_into_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, number): ``number`` counts equal lengths within the task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        import zlib

        from pyspark import TaskContext

        encoder, numbers = Encoder(tokenizer_file), [0] * (capacity + 1)
        task = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()

        def step(columns):
            out = [[] for _ in range(7)]
            for doc, text in zip(*columns, strict=True):
                found = encoder.encode(text or "") + end
                for k, (begin, length) in enumerate(cut_into_pieces(len(found) // 4, capacity)):
                    crc = zlib.crc32(found[4 * begin:4 * (begin + length)])
                    for values, value in zip(out, (doc, k, begin, length, crc, task, numbers[length]), strict=True):
                        values.append(value)
                    numbers[length] += 1
            return out

        return step

    return map_rows(docs, [id_col, text_col],
                    f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, number bigint",
                    start)


def fullest(counts: list[int], room: int) -> list[int]:
    """Lengths, longest first, whose sum is as near to ``room`` as the counts allow.

    ``reach[k]`` has bit s set if the first k steps (a length, or twice, four times ... that
    length) can sum to s; walking back over the steps gives the lengths.
    """
    full, steps, reach = (1 << (room + 1)) - 1, [], [1]
    for length in range(room, 0, -1):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take))
            reach.append((reach[-1] | (reach[-1] << (length * take))) & full)
            left, take = left - take, take * 2
        if reach[-1] >> room:
            break
    total, chosen = reach[-1].bit_length() - 1, []
    for k in range(len(steps), 0, -1):
        if not (reach[k - 1] >> total) & 1:
            length, take = steps[k - 1]
            chosen += [length] * take
            total -= length * take
    return sorted(chosen, reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins), by minimum bin slack."""
    counts, plan = [0] * (capacity + 1), []
    for length, n in histogram.items():
        counts[length] = n
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            lengths = [longest, *fullest(counts, capacity - longest)]
            counts[longest] += 1
            uses = {length: lengths.count(length) for length in lengths}
            times = min(counts[length] // n for length, n in uses.items())
            for length, n in uses.items():
                counts[length] -= n * times
            plan.append((lengths, times))
    return plan


def slots(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first number, sequence of the first number, place in the sequence), by first number."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            out.setdefault(length, []).append((given.get(length, 0), sequence, offset))
            given[length] = given.get(length, 0) + times
            offset += length
        sequence += times
    return {length: tuple(np.array(x, dtype=np.int64).T) for length, x in out.items()}


def numbers_before(counts: DataFrame) -> DataFrame:
    """(task, length, n) with ``before``: pieces of that length in earlier tasks, by two levels of sums."""
    blocks = counts.withColumn("block", F.floor(F.col("task") / BLOCK))
    inner = Window.partitionBy("length", "block").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("length", "block").agg(F.sum("n").alias("n")).select(
        "length", "block", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("outer"))
    return (blocks.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
            .join(totals, ["length", "block"]).select("task", "length", (F.col("inner") + F.col("outer")).alias("before")))


def pack(docs: DataFrame, tokenizer_file: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    Eager: writes the pieces to the shared folder and brings the counts by length (at most
    ``capacity`` rows) to the driver.
    """
    pieces = cut_lineage(token_pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col))
    counts = cut_lineage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(slots(plan_bins(histogram, capacity)))
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def step(columns):
            doc, piece, begin, length, crc, number, before = columns
            rank = np.array(number, np.int64) + np.array(before, np.int64)
            size = np.array(length, np.int64)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(size):
                rows = np.flatnonzero(size == value)
                first, base, place = places.value[int(value)]
                at = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = base[at] + rank[rows] - first[at], place[at]
            return [doc, piece, begin, length, crc, sequence, offset]

        return step

    numbered = pieces.join(numbers_before(counts).hint("merge"), ["task", "length"])
    return map_rows(numbered, [id_col, "piece", "start", "length", "ids_crc32", "number", "before"],
                    f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, "
                    "offset bigint", start)
