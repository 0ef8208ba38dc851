"""Line dedup: SimHash blocks of normalised lines, edit similarity, groups.

Lines are normalised (lower case, digits to 0, only letters and digits, single spaces); equal
normalised lines are one node. A node has SimHash blocks (see ``line_keys``) of which an edit damages
a few and leaves the others whole. One shuffle brings the nodes of a block together as (block,
node, length); nodes that share a block and whose lengths allow it are pairs, and pairs are verified
by edit similarity of at least ``similarity`` percent of the longer line. Linked lines form groups,
directly or through others. Of each group the first occurrence stays, by document id, content
hash and line number; all others are removed.

A block that more than PAIRS_AT nodes share gives no pairs: its nodes go, with their lines, to
one task or, in blocks of rows, to several (see ``families``), where only lines of different groups are
compared, first by counts of their characters. All of them are, so nothing is lost; a block so
frequent that a task sees it in one of 500 of its postings goes there without passing
through one task first.

What a pair of lines must have in common to be found is a block, not merely its similarity: with
one word or letter replaced, added or lost all pairs of 3 to 80 words do in the tests, and with every
twelfth word replaced as well; two damaged words in a line of 5 or 6 words often leave none.

Defined results: a null text stays null with 0 lines; lines without a letter or digit are never
removed; null ids count as the smallest; rows with equal id and text are one document, so they
lose the same lines; other columns are kept whatever their names, those named like a result are
replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm import families
from pitpanel.llm.common import append_columns, free_name, in_bits, listed_bits, perhaps_listed, quoted
from pitpanel.llm.components import connected
from pitpanel.llm.line_keys import block_keys, normal_lines
from pitpanel.session import cut_lineage

#: The smallest frequent blocks of a node, known in its others; two lines that share one are compared there only.
EARLIER = 16
#: Rows of a cell from which all are compared with one first, rows of cells, and pairs left, that are compared together, about.
LEADER, CELL_ROWS, OPEN_PAIRS = 32, 4000, 200_000
#: Nodes of one block that are paired; beyond, they go to ``hot_links``.
PAIRS_AT = 16
#: Pairs of neighbouring characters are counted in so many classes.
COUNTS = 128
#: Pairs compared together at most, characters of them, and pairs that are few enough to be compared one by one.
BATCH_PAIRS, BATCH_CELLS, FEW_PAIRS = 512, 1 << 21, 12
#: Beyond so many edits, runs of characters are counted first.
LONG_LIMIT, GRAM = 20, 8
#: Characters that two lines have in common after a difference, most characters of one difference, and characters of the runs in ``absent``.
ANCHOR, SKIP, RUN = 6, 64, 5
#: Beyond so many characters, lines must have runs in common, and more of them make it worth comparing them together.
LONG_LINE = 800
#: Bytes of lines whose blocks, and characters of lines whose counts, are made at once; lines that a task remembers; texts split at once.
BATCH_BYTES, BATCH_CHARACTERS, REMEMBERED, BATCH_TEXTS = 1 << 18, 1 << 18, 2_000_000, 500
#: A block in one of so many postings of a task is frequent there; one of so many of all postings is frequent for good.
TASK_SHARE, SHARE = 500, 5000


def line_digest(line: bytes) -> bytes:
    from xxhash import xxh128_digest

    return xxh128_digest(line)


def common(a: str, b: str, i: int, j: int) -> int:
    """Number of equal characters from a[i] and b[j] on."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 32
    while n + step <= most and a[i + n:i + n + step] == b[j + n:j + n + step]:
        n += step
        step *= 2
    step = min(step, most - n)
    while step:
        if n + step <= most and a[i + n:i + n + step] == b[j + n:j + n + step]:
            n += step
        else:
            step >>= 1
    return n


def middles(a: str, b: str) -> tuple[str, str]:
    """The shorter and the longer line without their common beginning and end."""
    if len(a) > len(b):
        a, b = b, a
    low = common(a, b, 0, 0)
    a, b = a[low:], b[low:]
    low, step = 0, len(a)
    while step:
        if a[len(a) - low - step:len(a) - low] == b[len(b) - low - step:len(b) - low]:
            low += step
            step = min(step, len(a) - low)
        else:
            step >>= 1
    return a[:len(a) - low], b[:len(b) - low]


def few_differences(a: str, b: str, limit: int) -> bool:
    """Whether the differences met on the way through both lines take ``limit`` edits at most; if not, fewer may still do.

    After each difference the nearest place is sought where ANCHOR characters are equal again.
    """
    i = j = 0
    while max(len(a) - i, len(b) - j) > limit:
        best, at = min(limit, SKIP) + 1, None
        for k in range(best):
            piece = a[i + k:i + k + ANCHOR]
            if k >= best or len(piece) < ANCHOR:
                break
            found = b.find(piece, j, j + best - 1 + ANCHOR)
            if found >= 0 and max(k, found - j) < best:
                best, at = max(k, found - j), (i + k, found)
        if at is None:
            return False
        limit -= best
        n = ANCHOR + common(a, b, at[0] + ANCHOR, at[1] + ANCHOR)
        i, j = at[0] + n, at[1] + n
    return limit >= 0


def runs_of(line: str) -> np.ndarray:
    """Hashes of all runs of RUN characters, once each, in order."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - RUN + 1
    out = codes[:n] * np.uint32(0x9E3779B1)
    for k in range(1, RUN):
        out = (out ^ (out >> np.uint32(15)) ^ codes[k:n + k]) * np.uint32(0x85EBCA77)
    return np.unique(out)


def absent(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the hashes x are not among y; an edit changes RUN of them at most."""
    if not len(y):
        return len(x)
    return len(x) - int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def edit_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most ``limit``: by bit vectors, column by column, after equal ends are cut off."""
    if abs(len(a) - len(b)) > limit:
        return False
    a, b = middles(a, b)
    if not a or limit >= len(b):
        return len(b) <= limit
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # rows where the distance goes up or down by one
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = places.get(c, 0)
        cross = (((same & up) + up) ^ up) | same
        right, back = down | (full & ~(cross | up)), up & cross
        if right & last:
            score += 1
        elif back & last:
            score -= 1
        if score - left > limit:
            return False
        right, back, same = (right << 1) | 1, back << 1, same | down
        up = (back | ~(same | right)) & full
        down = right & same & full
    return score <= limit


def alike(a: str, b: str, percent: int) -> bool:
    """Edit similarity of at least ``percent`` of the longer line; an edit changes at most GRAM runs of GRAM characters."""
    limit = (100 - percent) * max(len(a), len(b)) // 100
    if limit > LONG_LIMIT:
        runs = [Counter(x[k:k + GRAM] for k in range(len(x) - GRAM + 1)) for x in (a, b)]
        if (runs[0] - runs[1]).total() > GRAM * limit:
            return False
    return edit_within(a, b, limit)


def banded(pairs: list[tuple[str, str]], limits: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair (shorter, longer) is within its limit, all pairs at once.

    The table is filled antidiagonal by antidiagonal, in the band of diagonals that a distance
    within the limits can reach; ``d`` holds the last two antidiagonals, by diagonal.
    """
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    slack = (limits - (m - n)) // 2
    low, high = -int(slack.max()), int((m - n + slack).max())
    width = high - low + 1
    pad, far = width + 3, 1 << 28 if int(m.max()) > 8000 else 16_000
    codes = [np.full((int(size.max()) + 2 * pad, len(pairs)), none, np.int32) for size, none in ((n, -1), (m, -2))]
    for k, pair in enumerate(pairs):
        for table, text in zip(codes, pair, strict=True):
            table[pad:pad + len(text), k] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
    if max(int(c.max()) for c in codes) < 1 << 15:
        codes = [c.astype(np.int16) for c in codes]
    d = np.full((width + 2, len(pairs)), far, np.int32 if far > 16_000 else np.int16)
    d[1 - low] = 0
    out, left, rows = np.zeros(len(pairs), bool), n + m > 0, np.arange(len(pairs))
    out[~left] = True
    for s in range(1, int((n + m).max()) + 1):
        first = low + (low - s) % 2
        count = (high - first) // 2 + 1
        i, j, at = pad + (s - first) // 2 - 1, pad + (s + first) // 2 - 1, first - low + 1
        cells = d[at:at + 2 * count - 1:2]
        cells += codes[0][i - count + 1:i + 1][::-1] != codes[1][j:j + count]
        around = np.minimum(d[at - 1:at + 2 * count - 2:2], d[at + 1:at + 2 * count:2])
        around += 1
        np.minimum(cells, around, out=cells)
        done = np.flatnonzero(n + m == s)
        if len(done):
            out[rows[done]] = d[(m - n)[done] - low + 1, done] <= limits[done]
            left[done] = False
        if s % 16 == 0:
            left &= d.min(axis=0) <= limits
        if not left.any():
            break
        if s % 16 == 0 and 4 * left.sum() < 3 * len(left):  # go on with the pairs that are still open
            d, n, m, limits, rows = d[:, left], n[left], m[left], limits[left], rows[left]
            codes, left = [c[:, left] for c in codes], left[left]
    return out


def alike_many(xs: list[str], ys: list[str], percent: int, known: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """``alike`` of each pair. Most are settled by the differences met on the way or, with many edits, by runs of
    characters that must be common; the others are compared together, in batches of about the same length.

    ``known`` keeps the runs of lines that are compared again.
    """
    out, known = np.zeros(len(xs), bool), {} if known is None else known
    pairs, limits, order = [], np.array([(100 - percent) * max(len(x), len(y)) // 100 for x, y in zip(xs, ys, strict=True)], np.int64), []
    for k, (x, y, limit) in enumerate(zip(xs, ys, limits.tolist(), strict=True)):
        pairs.append(("", ""))
        if abs(len(x) - len(y)) > limit:
            continue
        a, b = middles(x, y)
        if len(b) <= limit or few_differences(a, b, limit):
            out[k] = True
            continue
        if len(b) > LONG_LINE:
            for line in (x, y):
                if line not in known:
                    known[line] = runs_of(line)
            if max(absent(known[x], known[y]), absent(known[y], known[x])) > RUN * limit:
                continue
        pairs[k] = (a, b)
        order.append(k)
    order.sort(key=lambda k: len(pairs[k][1]))
    at = 0
    while at < len(order):
        longest, end = 1, at
        while end < len(order) and end - at < BATCH_PAIRS and max(longest, len(pairs[order[end]][1])) * (end - at + 1) <= BATCH_CELLS:
            longest = max(longest, len(pairs[order[end]][1]))
            end += 1
        rows = order[at:max(end, at + 1)]
        if len(rows) < (FEW_PAIRS if longest <= LONG_LINE else 4 * FEW_PAIRS):
            out[rows] = [edit_within(*pairs[k], int(limits[k])) for k in rows]
        else:
            out[rows] = banded([pairs[k] for k in rows], limits[rows])
        at += len(rows)
    return out


def pair_counts(lines: list[str]) -> np.ndarray:
    """(lines, COUNTS) of pairs of neighbouring characters by class, up to 255 each; an edit changes four at most, by 1."""
    out = np.zeros((len(lines), COUNTS), np.uint8)
    for low, high in byte_batches(lines, BATCH_CHARACTERS):
        data = [line.encode("utf-32-le", "surrogatepass") for line in lines[low:high]]
        codes = np.frombuffer(b"".join(data), np.uint32)
        owner = np.repeat(np.arange(high - low, dtype=np.int32), [len(d) // 4 for d in data])
        spot = ((codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]) * np.uint32(0x85EBCA77) >> np.uint32(13)) % np.uint32(COUNTS)
        inside = owner[1:] == owner[:-1]
        place = owner[:-1][inside] * COUNTS + spot[inside].astype(np.int32)
        out[low:high] = np.minimum(np.bincount(place, minlength=(high - low) * COUNTS), 255).reshape(-1, COUNTS)
    return out


def may_be_alike(x: np.ndarray, y: np.ndarray, longer: np.ndarray, percent: int) -> np.ndarray:
    """Whether lines with the pair counts of the rows of x and y, the longer of so many characters, can be within the edits."""
    apart = np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64)
    return apart <= 4 * ((100 - percent) * longer // 100)


class Labels:
    """Labels of rows, joined as links are found."""

    def __init__(self, labels: list[int]):
        self.names, self.at = np.unique(np.array(labels, np.int64), return_inverse=True)
        self.root = np.arange(len(self.names))

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The number of the smallest label that each row's is joined with."""
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root[self.at[rows]]

    def top(self, row: int) -> int:
        k = int(self.at[row])
        while (up := int(self.root[k])) != k:
            k = up
        return k

    def link(self, i: int, j: int) -> list[tuple[int, int]]:
        """Join the labels of two rows; (label, label) unless they were joined."""
        x, y = self.top(i), self.top(j)
        if x == y:
            return []
        self.root[max(x, y)] = min(x, y)
        return [(int(self.names[x]), int(self.names[y]))]


def cells_links(cells: list[tuple[int, int]], labels: list[int], lines: list[str], counts: np.ndarray, percent: int,
                earlier: list[list[int]] | None = None) -> list[tuple[int, int]]:
    """(label, label) of lines that are alike and in one of the ``cells`` (first row, one past the last).

    Lines whose labels are joined by then are not compared, nor are lines of a cell that have one of their ``earlier``
    blocks in common, as they meet there. The pairs of all cells are compared together, in rounds: in a large cell first
    all lines with the one of middle length, then every line with one shorter line, with two more, and so on.
    """
    lengths, joined, known, out = np.array([len(x) for x in lines], np.int64), Labels(labels), {}, []

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        passed = alike_many([lines[k] for k in i.tolist()], [lines[k] for k in j.tolist()], percent, known)
        for x, y in zip(i[passed].tolist(), j[passed].tolist(), strict=True):
            out.extend(joined.link(x, y))

    def rounds(found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        most = 1
        while True:
            apart = joined.of(i) != joined.of(j)
            i, j = i[apart], j[apart]
            if not len(i):
                return
            first = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
            now = np.arange(len(j)) - np.repeat(first, np.diff(np.append(first, len(j)))) < most
            settle(i[now], j[now])
            i, j, most = i[~now], j[~now], most * 2

    orders, stars = [], []
    for low, high in cells:
        rows = np.array(sorted(range(low, high), key=lambda k: (len(lines[k]), lines[k])), np.int64)
        orders.append(rows)
        if len(rows) > LEADER:
            middle = rows[len(rows) // 2]
            near = rows[joined.at[rows] != joined.at[middle]]
            longer, shorter = np.maximum(lengths[near], lengths[middle]), np.minimum(lengths[near], lengths[middle])
            near = near[(100 * shorter >= percent * longer) & may_be_alike(counts[near], counts[middle], longer, percent)]
            stars.append((np.full(len(near), middle), near))
    for i, j in stars:
        apart = joined.of(i) != joined.of(j)
        settle(i[apart], j[apart])
    found, size = [], 0
    for rows in orders:
        label = joined.of(rows)
        if not (label != label[0]).any():
            continue
        meet: dict[int, list[int]] = {}
        for k, row in enumerate(rows.tolist()) if earlier else ():
            for block in earlier[row]:
                meet.setdefault(block, []).append(k)
        together = {block: np.array(places_) for block, places_ in meet.items() if len(places_) > 1}
        sizes, many = lengths[rows], counts[rows]
        least = np.searchsorted(sizes, -(-sizes * percent // 100))  # the shortest line that the lengths allow
        for k in range(1, len(rows)):
            near = label[least[k]:k] != label[k]
            if not near.any():
                continue
            for block in earlier[rows[k]] if earlier else ():
                if block in together:
                    spots = together[block]
                    near[spots[(spots >= least[k]) & (spots < k)] - least[k]] = False
            near = np.flatnonzero(near) + least[k]
            near = near[may_be_alike(many[near], many[k], sizes[k], percent)]
            if len(near):
                found.append((rows[near], np.full(len(near), rows[k])))
                size += len(near)
        if size > OPEN_PAIRS:
            rounds(found)
            found, size = [], 0
    if found:
        rounds(found)
    return out


def group_links(labels: list[int], lines: list[str], counts: np.ndarray, percent: int,
                earlier: list[list[int]] | None = None) -> list[tuple[int, int]]:
    """``cells_links`` of the lines of one cell."""
    return cells_links([(0, len(lines))], labels, lines, counts, percent, earlier)


def byte_batches(lines: list, most: int):
    """Numbers of the first and one past the last line of batches of about ``most`` bytes or characters."""
    at, size = 0, 0
    for k, line in enumerate(lines):
        size += len(line)
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(lines):
        yield at, len(lines)


def occurrences(base: DataFrame, least: int) -> DataFrame:
    """(row_id, row_key, no, la, lb, n, line, blocks) of every line that has a letter or digit, itself and its blocks once a task,
    and rows (frequent, times) of the blocks that a task has very often."""
    kind = base.schema["row_id"].dataType.simpleString()
    out = base.sparkSession.createDataFrame(
        [], f"row_id {kind}, row_key bigint, no int, la bigint, lb bigint, n bigint, line string, blocks array<bigint>, frequent bigint, times bigint").schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, seen, posted = to_arrow_schema(out), set(), Counter()
        total = 0
        for batch in (b.slice(k, BATCH_TEXTS) for b in batches for k in range(0, b.num_rows, BATCH_TEXTS)):
            rows, numbers, lines = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for no, line in enumerate(normal_lines(text or "")):
                    if line:
                        rows.append(k)
                        numbers.append(no)
                        lines.append(line)
            digests = np.frombuffer(b"".join(map(line_digest, lines)), np.int64).reshape(-1, 2)
            new = []
            for k, a in enumerate(digests[:, 0].tolist()):
                if a not in seen:
                    seen.add(a)
                    new.append(k)
            if len(seen) > REMEMBERED:
                seen.clear()
            found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            mine = [lines[k] for k in new]
            for low, high in byte_batches(mine, BATCH_BYTES):
                row, key = block_keys(mine[low:high], least)
                found[0].append(np.array(new[low:high])[row])
                found[1].append(key)
            row, key = (np.concatenate(f) for f in found)
            order = np.argsort(row, kind="stable")
            sizes = np.bincount(row, minlength=len(lines))
            total += len(key)
            keys, times = np.unique(key, return_counts=True)
            often = times > max(1, len(key) // (4 * TASK_SHARE))
            posted.update(dict(zip(keys[often].tolist(), times[often].tolist(), strict=True)))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            is_new = np.zeros(len(lines), bool)
            is_new[new] = True
            blocks = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~is_new, False)), pa.array(key[order]))
            once: list = [None] * len(lines)
            for k in new:
                once[k] = lines[k]
            take = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(digests[:, 0]),
                       pa.array(digests[:, 1]), pa.array([len(x) if x.isascii() else len(x.decode("utf-8")) for x in lines], pa.int64()),
                       pa.array(once, pa.binary()).cast(pa.string()), blocks,
                       pa.nulls(len(lines), pa.int64()), pa.nulls(len(lines), pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        heavy = {key: n for key, n in posted.items() if n * TASK_SHARE >= total and n > PAIRS_AT}
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(heavy), f.type) for f in list(arrow)[:8]), pa.array(list(heavy), pa.int64()),
                                          pa.array(list(heavy.values()), pa.int64())], schema=arrow)

    return base.mapInArrow(run, out)


class Runs:
    """Rows sorted by block, batch after batch, to pairs of nodes that share one, or to all nodes of a block that many share."""

    def __init__(self, percent: int):
        self.percent = percent
        self.rest = [np.zeros(0, np.int64) for _ in range(3)]
        self.long: int | None = None  # the block of a long run that goes on

    def feed(self, rows: list[np.ndarray], last: bool) -> list[np.ndarray]:
        """(kind, a, b, n): kind 0 a pair of nodes, 1 a block (a) and a node (b) of n characters."""
        key, node, n = (np.concatenate([old, new]) for old, new in zip(self.rest, rows, strict=True))
        out = []
        if self.long is not None and len(key):
            same = key == self.long
            out.append((1, key[same], node[same], n[same]))
            if not same.all():
                self.long = None
            key, node, n = key[~same], node[~same], n[~same]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        ends = np.append(starts[1:], len(key)) if len(key) else starts
        keep = len(key)
        if len(starts) and not last:
            a = int(starts[-1])
            if len(np.unique(node[a:])) > PAIRS_AT:
                self.long = int(key[a])
            else:
                keep, starts, ends = a, starts[:-1], ends[:-1]
        self.rest = [x[keep:] for x in (key, node, n)]
        two = starts[ends - starts == 2]
        two = two[(node[two] != node[two + 1]) & (100 * np.minimum(n[two], n[two + 1]) >= self.percent * np.maximum(n[two], n[two + 1]))]
        out.append((0, np.minimum(node[two], node[two + 1]), np.maximum(node[two], node[two + 1]), np.minimum(n[two], n[two + 1])))
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            nodes, first = np.unique(node[a:b], return_index=True)
            sizes = n[a:b][first]
            if len(nodes) > PAIRS_AT:
                out.append((1, np.full(len(nodes), key[a]), nodes, sizes))
            elif len(nodes) > 1:
                i, j = np.triu_indices(len(nodes), 1)
                near = 100 * np.minimum(sizes[i], sizes[j]) >= self.percent * np.maximum(sizes[i], sizes[j])
                out.append((0, nodes[i[near]], nodes[j[near]], sizes[i[near]]))
        return [np.concatenate([np.full(len(a), k, np.int64) for k, a, _, _ in out]), *(np.concatenate([o[k] for o in out]) for k in (1, 2, 3))]


def shared_blocks(found: DataFrame, percent: int) -> DataFrame:
    """(kind, a, b, n) as ``Runs`` gives them, stored. Eager."""
    often = found.filter("frequent is not null").groupBy("frequent").agg(F.sum("times").alias("times"))
    total = found.agg(F.sum(F.size("blocks").cast("bigint"))).first()[0] or 0
    often = cut_lineage(often.filter(F.col("times") * SHARE >= total).select(F.col("frequent").alias("key")))  # at most SHARE rows
    posted = found.filter("blocks is not null").select(F.explode("blocks").alias("key"), F.col("la").alias("node"), "n")
    kind = "kind bigint, a bigint, b bigint, n bigint"

    def run(batches):
        import pyarrow as pa

        runs, names = Runs(percent), ["kind", "a", "b", "n"]
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs.feed(rows, False)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs.feed([np.zeros(0, np.int64)] * 3, True)], names=names)

    dealt = posted.join(F.broadcast(often), "key", "left_anti").repartition("key").sortWithinPartitions("key")
    hot = posted.join(F.broadcast(often), "key").select(F.lit(1).cast("bigint").alias("kind"), F.col("key").alias("a"), F.col("node").alias("b"), "n")
    met = dealt.mapInArrow(run, kind).unionByName(hot)
    return cut_lineage(met.groupBy("kind", "a", "b").agg(F.max("n").alias("n")))


def wanted_lines(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line, n, counts) of the ``nodes``, stored. Eager."""
    size, bits = listed_bits(nodes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(pa.array(in_bits(batch.column(0).to_numpy(), size, bits.value)))
            counts = [row.tobytes() for row in pair_counts(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.binary())], names=["node", "line", "n", "counts"])

    lines = found.filter("line is not null").select("la", "line", "n").mapInArrow(run, "node bigint, line string, n bigint, counts binary")
    return cut_lineage(lines.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min("line").alias("line"), F.min("n").alias("n"), F.min("counts").alias("counts")))


def verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``pairs`` (a, b) that are alike; only those whose counts allow it fetch their lines."""
    def beside(rows: DataFrame, *columns: str) -> DataFrame:
        for end in ("a", "b"):
            rows = rows.join(lines.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
        return rows.select("a", "b", *[f"{c}_{end}" for end in ("a", "b") for c in columns])

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            n, x, m, y = (batch.column(k) for k in range(2, 6))
            longer = np.maximum(n.to_numpy(), m.to_numpy())
            counts = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COUNTS) for c in (x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(may_be_alike(*counts, longer, percent)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(alike_many(batch.column(2).to_pylist(), batch.column(3).to_pylist(), percent)))

    close = cut_lineage(beside(pairs, "n", "counts").mapInArrow(near, "a bigint, b bigint"))
    return beside(close, "line").mapInArrow(run, "a bigint, b bigint")


def in_cells(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels that two alike lines of one cell have, of ``rows`` (cell, family, label, line, counts, known)."""
    def links(rows) -> tuple[list[int], list[int]]:
        cell = rows.column("cell").combine_chunks().dictionary_encode().indices.to_numpy()
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])).tolist()
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).reshape(-1, COUNTS)
        earlier = [[block for block in known if block < family] for family, known in
                   zip(rows.column("family").to_pylist(), rows.column("known").to_pylist(), strict=True)]
        found = cells_links(list(zip(at[:-1], at[1:], strict=True)), rows.column("label").to_pylist(), rows.column("line").to_pylist(), counts, percent, earlier)
        return [a for a, _ in found], [b for _, b in found]

    def run(batches):
        import pyarrow as pa

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(rows)], names=["a", "b"])

        rest = None  # rows of cells of which more may follow
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cells = rest.column("cell")
            if rest.num_rows < CELL_ROWS or cells[0] == cells[-1]:
                continue
            low, high, last = 0, rest.num_rows - 1, cells[-1]
            while low < high:  # the first row of the last cell
                middle = (low + high) // 2
                low, high = (low, middle) if cells[middle] == last else (middle + 1, high)
            yield made(rest.slice(0, low))
            rest = rest.slice(low)
        if rest is not None and rest.num_rows:
            yield made(rest)

    return (rows.select("cell", "family", "label", "line", "counts", "known").repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(run, "a bigint, b bigint"))


def hot_links(hot: DataFrame, links: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(a, b) of nodes that are linked, directly or through others, by lines that share a block of ``hot`` (family, node, n) or by ``links``. Eager."""
    label = connected(links, "a", "b").withColumnRenamed("root", "label")
    held = hot.groupBy("node").agg(F.array_sort(F.collect_set("family")).alias("families"))
    held = cut_lineage(held.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).join(lines, "node"))
    known = F.slice("families", 1, EARLIER).alias("known")
    rows = held.select(F.explode("families").alias("family"), "node", "label", "n", "line", "counts", known)
    wide = cut_lineage(hot.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size")).filter(
        (F.col("rows") > 2 * families.BLOCK_ROWS) | (F.col("size") > 2 * families.BLOCK_SIZE)).select("family"))
    ends = held.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b")
    if wide.isEmpty():
        return ends.unionByName(in_cells(rows.withColumn("cell", F.col("family").cast("string")), percent))
    narrow = rows.join(wide, "family", "left_anti").withColumn("cell", F.col("family").cast("string"))
    beside = held.select("node", "line", "counts", known)

    def join(rows: DataFrame) -> DataFrame:
        return in_cells(rows.select("cell", "family", "node", "label").join(beside, "node"), percent)

    members = cut_lineage(rows.select("family", "node", "label", "n").join(wide, "family", "left_semi"))
    met = families.family_links(members, join).select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b")
    return ends.unionByName(in_cells(narrow, percent)).unionByName(met)


def line_groups(found: DataFrame, percent: int) -> DataFrame:
    """(la, label) of the lines that are alike to another, label being the same within a group. Eager."""
    met = shared_blocks(found, percent)
    pairs, hot = met.filter("kind = 0").select("a", "b"), met.filter("kind = 1").select(F.col("a").alias("family"), F.col("b").alias("node"), "n")
    nodes = cut_lineage(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
                        .unionByName(hot.select("node")).distinct())
    lines = wanted_lines(found, nodes)
    links = cut_lineage(verified(pairs, lines, percent))
    if not hot.isEmpty():
        links = cut_lineage(links.unionByName(hot_links(hot, links, lines, percent)))
    return connected(links, "a", "b").select(F.col("node").alias("la"), F.col("root").alias("label"))


def repeated_lines(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """(row_id, row_key, no, group) of the ``lines`` that stand more than once or are in one of ``groups`` (la, label), stored.

    ``group`` is the same for lines of one group, or for equal lines of none. Lines that stand once alone are not
    carried on; what is read of them is counted by hash, and one shuffle finds the others. Eager.
    """
    equal = lines.groupBy("la", "lb").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("la", "lb", F.lit(None).cast("bigint").alias("label"))
    wanted = equal.unionByName(groups.select("la", F.lit(None).cast("bigint").alias("lb"), "label"))
    wanted = cut_lineage(wanted.groupBy("la").agg(F.max("label").alias("label"), F.collect_set("lb").alias("equal")))
    rows = lines.select("row_id", "row_key", "no", "la", "lb").join(wanted, "la").filter(F.col("label").isNotNull() | F.array_contains("equal", F.col("lb")))
    alone = F.col("label").isNull()
    return cut_lineage(rows.select("row_id", "row_key", "no", F.struct(~alone, F.coalesce("label", "la"), F.when(alone, F.col("lb"))).alias("group")))


def remove_lines(docs: DataFrame, *, similarity: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and n_lines, n_removed. Eager: writes its steps."""
    key = F.xxhash64(text_col)
    base = docs.select(F.col(id_col).alias("row_id"), key.alias("row_key"), F.col(text_col).alias("text"))
    found = cut_lineage(occurrences(base, -(-100 // (100 - similarity))))
    hits = repeated_lines(found.filter("no is not null"), line_groups(found, similarity))
    place = F.struct("row_id", "row_key", "no")
    first = hits.groupBy("group").agg(F.min(place).alias("stays"))
    gone = cut_lineage(hits.join(first, hits["group"].eqNullSafe(first["group"])).drop("group").filter(~F.col("stays").eqNullSafe(place))
                       .groupBy("row_id", "row_key").agg(F.collect_set("no").alias("gone")))
    names = {name: free_name(docs.columns, name) for name in ("row_id", "row_key", "gone")}
    touched = docs.withColumn(names["row_key"], key)
    listed = perhaps_listed(gone.select("row_key"))(names["row_key"])
    gone = gone.select(*[F.col(c).alias(f"{names[c]}") for c in ("row_id", "row_key", "gone")])
    same = F.col(id_col).eqNullSafe(F.col(names["row_id"])) & touched[names["row_key"]].eqNullSafe(gone[names["row_key"]])
    marked = touched.filter(listed).join(gone, same, "left").select(*[touched[quoted(c)] for c in docs.columns], names["gone"])
    whole = touched.filter(~listed).select(*map(quoted, docs.columns), F.lit(None).cast("array<int>").alias(names["gone"]))

    def start():
        def step(columns):
            texts, counts, removed = [], [], []
            for text, gone in zip(*columns, strict=True):
                lines = [] if text is None else text.split("\n")
                out = set(gone or ())
                texts.append("\n".join(line for no, line in enumerate(lines) if no not in out) if out else text)
                counts.append(len(lines))
                removed.append(len(out))
            return [texts, counts, removed]

        return step

    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", text_col)]
    return append_columns(marked.unionByName(whole), [text_col, names["gone"]], f"{quoted(text_col)} string, n_lines bigint, n_removed bigint", start).select(
        *map(quoted, [*kept, text_col]), "n_lines", "n_removed")
