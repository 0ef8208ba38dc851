"""Normalised lines and the SimHash blocks that similar lines share.

A line's blocks are SimHashes of some of its words (bit k is set if most of these words have it in
their hash), cut so that an edit leaves blocks whole:

* lines of LONG_FROM words or more: runs of LONG_RUN words, those of the first half counted from
  the front and those of the second half, as an added word moves all that follow, from the back.
  d replaced words leave all but d of the runs (pigeonhole).
* lines of MIDDLE_FROM to LONG_FROM words: runs of MIDDLE_RUN words, all from the front and all from the back;
  lines of SHORT_FROM to MIDDLE_FROM words: the same with runs of SHORT_RUN words.
* lines of DELETE_FROM to DELETE_TO words: all words, and all words but one, each left out in turn,
  so that two lines with one damaged, added or lost word share a block.
* shorter lines: runs of CHARACTERS bytes from the front and from the back.

Lines in two of these classes have the blocks of both. Lines too short for any edit have none.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Least words of a line and words of a run, for long, middling and short lines.
LONG_FROM, LONG_RUN, MIDDLE_FROM, MIDDLE_RUN, SHORT_FROM, SHORT_RUN = 18, 6, 12, 4, 6, 3
DELETE_FROM, DELETE_TO, CHARACTERS = 4, 7, 5
#: A letter or digit; runs of the digit 0; a digit; ASCII bytes to lower case, digits to 0, others to spaces; the same in UTF-8.
LETTER, ZEROS, DIGIT = re.compile(r"[^\W_]"), re.compile(rb"00+"), re.compile(r"\d")
ASCII = bytes(10 if b == 10 else b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if 97 <= b <= 122 else 32 for b in range(256))
UTF8 = ASCII[:128] + bytes(range(128, 256))
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1 << 16)
def plain(c: str) -> str:
    """A character beyond ASCII as normalised lines have it: itself, 0 for a digit, a space if no letter or digit."""
    return "0" if DIGIT.match(c) else c if LETTER.match(c) else " "


def normal_lines(text: str) -> list[bytes]:
    """Every line in lower case, runs of digits as 0, letters and digits only, single spaces; as UTF-8."""
    if text.isascii():
        data = text.encode("ascii").translate(ASCII)
    else:
        text = text.lower()
        for c in set(text):
            if c > "\x7f" and plain(c) != c:
                text = text.replace(c, plain(c))
        data = text.encode("utf-8").translate(UTF8)
    return [b" ".join(line.split()) for line in (ZEROS.sub(b"0", data) if b"00" in data else data).split(b"\n")]


def normalise(line: str) -> str:
    return normal_lines(line.replace("\n", " "))[0].decode("utf-8")


def mixed(h: np.ndarray) -> np.ndarray:
    h = np.atleast_1d(h)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * MIX


#: A number for each byte, and the factor (and its inverse modulo 2^64) of a byte's place in the sums that word hashes come from.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)
FACTOR = 0xD6E8FEB86659FD93
INVERSE = pow(FACTOR, -1, 1 << 64)
#: Bytes of a batch up to which the powers of the factors are kept.
USUAL = 1 << 19


@lru_cache(2)
def many_powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def powers(factor: int, n: int) -> np.ndarray:
    """The first ``n`` powers; those of batches of the usual size are made once."""
    return many_powers(factor, USUAL)[:n] if n <= USUAL else many_powers.__wrapped__(factor, n)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' numbers by place, from which ``hashes_of`` takes the hash of any run of them."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * powers(FACTOR, len(data)))])


def hashes_of(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from ``start`` to ``end``: differences of running sums, moved to place 0."""
    return mixed((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def majority(words: np.ndarray) -> np.ndarray:
    """SimHash of the rows of a (rows, words) table of hashes: counters of all 64 bits at once, bit plane by bit plane."""
    width = words.shape[1]
    planes = max(2, (width + 1).bit_length() + 1)
    start = (1 << (planes - 1)) - (width // 2 + 1)  # the top plane gets set by more than half of the words
    counts = [np.full(len(words), ~np.uint64(0) if start >> p & 1 else np.uint64(0)) for p in range(planes)]
    for k in range(width):
        carry = words[:, k]
        for p in range(planes):
            counts[p], carry = counts[p] ^ carry, counts[p] & carry
    return counts[-1]


def keyed(hashes: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """Hashes of different ``kind`` apart."""
    return mixed(hashes ^ mixed(np.asarray(kind).astype(np.uint64) * MIX))


def places(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of ``times`` entries of each row."""
    row = np.repeat(np.arange(len(times)), times)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)


def word_runs(h: np.ndarray, start: np.ndarray, n: np.ndarray, rows: np.ndarray, width: int, halves: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the runs of ``width`` words of ``rows``; with ``halves`` either side has its half of them."""
    times, out = n[rows] // width, []
    for side in (0, 1):
        row, number = places((times + 1 - side) // 2 if halves else times)
        row = rows[row]
        at = start[row] + (n[row] - (number + 1) * width if side else number * width)
        out.append((row, keyed(majority(h[at[:, None] + np.arange(width)]), (width << 40) + (number << 1) + side)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def block_keys(lines: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, block), a row for each block, of lines of ``least`` characters or more."""
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    ends = np.flatnonzero((data == 10) | (data == 32))
    starts = np.concatenate([[0], ends[:-1] + 1])
    line = np.concatenate([[0], np.cumsum(data[ends[:-1]] == 10)])
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    from_byte, to_byte = starts[first], ends[np.append(first[1:], len(ends)) - 1]
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    sums = byte_sums(data)
    h = hashes_of(sums, starts, ends)
    n = np.diff(np.append(first, len(line)))
    n[characters[to_byte] - characters[from_byte] < max(least, 1)] = 0
    found = [word_runs(h, first, n, np.flatnonzero(n >= LONG_FROM), LONG_RUN, True),
             word_runs(h, first, n, np.flatnonzero((n >= MIDDLE_FROM) & (n <= LONG_FROM)), MIDDLE_RUN, False),
             word_runs(h, first, n, np.flatnonzero((n >= SHORT_FROM) & (n <= MIDDLE_FROM)), SHORT_RUN, False)]
    for width in range(DELETE_FROM, DELETE_TO + 1):
        rows = np.flatnonzero(n == width)
        words = h[first[rows][:, None] + np.arange(width)]
        found.append((rows, keyed(majority(words), (1 << 50) + width)))
        found += [(rows, keyed(majority(np.delete(words, k, axis=1)), (1 << 50) + width - 1)) for k in range(width)]
    rows = np.flatnonzero((n > 0) & (n <= DELETE_FROM))
    row, number = places((to_byte[rows] - from_byte[rows]) // CHARACTERS)
    row = rows[row]
    for side, at in enumerate((from_byte[row] + number * CHARACTERS, to_byte[row] - (number + 1) * CHARACTERS)):
        found.append((row, keyed(hashes_of(sums, at, at + CHARACTERS), (1 << 52) + (number << 1) + side)))
    return np.concatenate([r for r, _ in found]), np.concatenate([k for _, k in found]).view(np.int64)
