"""N-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct 5-word shingles. Linked sets are similar, so
they share a shingle among the first n - ceil(0.75 n) + 1 of either in any fixed order; the
order takes shingles that many documents have last. One shuffle brings the sets that have a shingle in
these prefixes together as (shingle, set, size, place in the order). Up to PAIRS_AT sets give all
pairs whose sizes and places leave room for the overlap that a link needs. The sets of a shingle
that more sets share go on with their bitmaps alone, as *crowds* (shingles with a set in common are
one crowd), and signature trees say which of them may be linked.

A signature tree's leaves are sets ordered by size, and every node above holds the OR of the token
bitmaps below it, the range of set sizes and the largest number of tokens that fall on an occupied
bit. A crowd is cut into bands of size, as sets of one band are linked within it or with the next
one, and large bands into blocks that meet pairwise; for each a tree is traversed together with
itself from the root. A pair of nodes is dropped if their size ranges are too far apart, if the bits
they share plus the doubled tokens cannot make the overlap that a link needs, or if all sets below
both are known to hang together. What is left ties sets that may be linked, directly or through
others: *families*, which no link leaves. Most sets are in none.

Only the texts of families are fetched, once, and their sets are compared exactly, again by a tree
with larger bitmaps; large families are cut into blocks (see ``families``). Sets of one known component
are not compared, so a family of near copies costs about as much as its size, and every pair of sets
that could link two components is compared. Exact copies share one set throughout. Sets are
told apart by 128 bits of their digest; ids are only labels.

Defined results: a null text, or one without words, has an empty set, is linked with nothing
and is its own component; a text of fewer words than a shingle is one shingle; a row without
id gets the component of the rows with the same set, else null, and links nothing itself;
repeated rows stay, a row each; rows with one id and different texts are judged by their texts;
ids must be integers; columns other than the two are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import perhaps_listed
from pitpanel.llm.components import connected
from pitpanel.llm.families import families, family_links
from pitpanel.session import cut_lineage

PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Least bits of a bitmap; sets below a node of a tree.
LEAST_BITS, FANOUT = 1024, 8
#: Shingles whose frequency changes the order; a longer list would only save time.
FREQUENT = 300_000
#: Sets of one shingle that are paired; sets of a shingle by the list beyond which its rows need not meet in one task.
PAIRS_AT, HOT_SETS = 64, 1000
#: Sets of a crowd's band that one tree holds; shingles whose counts a task holds.
CELL_SETS, HELD_SHINGLES = 2000, 4_000_000


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * PRIME + w[k:len(w) - size + 1 + k]
    h = (h ^ (h >> np.uint64(29))) * MIX
    return np.unique(h ^ (h >> np.uint64(32)))


def digest(found: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64).tolist()
    return a, b


def prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The shingles that a similar set must share one of; frequent ones come last in the order."""
    n = len(found)
    keep = n - -(-percent * n // 100) + 1
    hashes, counts = frequent
    rank = np.zeros(n, np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        rank = np.where(hashes[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))[:keep]]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def bitmap_bits(n: int, each: int) -> int:
    """A power of two of at least ``each`` bits for every shingle."""
    return max(LEAST_BITS, 1 << (each * n - 1).bit_length()) if n else LEAST_BITS


def bitmap(found: np.ndarray, size: int | None = None) -> np.ndarray:
    """``size`` bits (two or more a shingle by default); one is set for every shingle, by its hash."""
    size = size or bitmap_bits(len(found), 2)
    bits = np.zeros(size, bool)
    bits[(found & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of ``size`` bits, as rows of 64-bit words, from bitmaps of as many or more."""
    lengths, out = np.array([len(m) for m in maps]), np.zeros((len(maps), size // 64), np.uint64)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        words = np.frombuffer(b"".join(maps[k] for k in rows.tolist()), np.uint64)
        out[rows] = np.bitwise_or.reduce(words.reshape(len(rows), 8 * length // size, size // 64), axis=1)
    return out


def possible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sizes and bitmaps allow a link; ``signatures``: (sa, n, bits)."""
    both = (pairs.join(signatures.select(F.col("sa").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
            .join(signatures.select(F.col("sa").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            maps = [batch.column(k).to_pylist() for k in (4, 5)]
            size, keep = np.array([8 * min(len(x), len(y)) for x, y in zip(*maps, strict=True)], np.int64), np.zeros(len(na), bool)
            for bits in np.unique(size).tolist():
                rows = np.flatnonzero(size == bits)
                x, y = (folded([m[k] for k in rows.tolist()], bits) for m in maps)
                n, m = na[rows], nb[rows]
                slack = np.minimum(n - np.bitwise_count(x).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y).sum(axis=1, dtype=np.int64))
                overlap = slack + np.bitwise_count(x & y).sum(axis=1, dtype=np.int64)
                keep[rows] = (100 + percent) * np.minimum(overlap, np.minimum(n, m)) >= percent * (n + m)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint")


def describe(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """A row (id, sa, sb, n, bits) for each document, bits being its token bitmap, and a row
    (hash, times) for each shingle that several documents of a task have."""
    def run(batches):
        import pyarrow as pa

        names = ["id", "sa", "sb", "n", "bits", "hash", "times"]
        many: list[np.ndarray] = []

        def repeated():
            hashes, times = np.unique(np.concatenate(many), return_counts=True)
            many.clear()
            hashes, times = signed(hashes[times > 1]), times[times > 1]
            null = pa.nulls(len(hashes), pa.int64())
            return pa.RecordBatch.from_arrays([null, null, null, null, pa.nulls(len(hashes), pa.binary()), pa.array(hashes), pa.array(times)], names=names)

        for batch in batches:
            found = [shingles(text, size) for text in batch.column(1).to_pylist()]
            sums = [digest(f) for f in found]
            null = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([a for a, _ in sums], pa.int64()),
                                              pa.array([b for _, b in sums], pa.int64()),
                                              pa.array([len(f) for f in found], pa.int64()),
                                              pa.array([bitmap(f).tobytes() for f in found], pa.binary()), null, null], names=names)
            many += found
            if sum(map(len, many)) > HELD_SHINGLES:
                yield repeated()
        if many:
            yield repeated()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_col).mapInArrow(
        run, "id bigint, sa bigint, sb bigint, n bigint, bits binary, hash bigint, times bigint")


def postings(docs: DataFrame, frequent, size: int, percent: int, text_col: str) -> DataFrame:
    """(key, node, size_place): the prefix shingles of every set, once for each task that has the set.

    ``size_place`` holds the set's size and the shingle's place in its order, or -1 if by the list more
    than HOT_SETS sets have the shingle.
    """
    def run(batches):
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        known, times = frequent.value
        for batch in batches:
            hashes, sets, packed = [], [], []
            for text in batch.column(0).to_pylist():
                found = shingles(text, size)
                key = digest(found)
                if len(found) and key not in seen:
                    seen.add(key)
                    hashes.append(prefix(found, frequent.value, percent))
                    sets.append(np.full(len(hashes[-1]), key[0], np.int64))
                    packed.append((len(found) << 32) + np.arange(len(hashes[-1])))
            if hashes:
                hash_, packed_ = np.concatenate(hashes), np.concatenate(packed)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hash_), len(known) - 1)
                    packed_[(known[at] == hash_) & (times[at] > HOT_SETS)] = -1
                yield pa.RecordBatch.from_arrays([pa.array(signed(hash_)), pa.array(np.concatenate(sets)), pa.array(packed_)], names=["key", "node", "size_place"])

    return docs.select(text_col).mapInArrow(run, "key bigint, node bigint, size_place bigint")


class Runs:
    """Rows sorted by key, batch after batch, to pairs of nodes that share one, or to all nodes of a key that many share."""

    def __init__(self, percent: int):
        self.percent = percent
        self.rest = [np.zeros(0, np.int64) for _ in range(4)]
        self.long: int | None = None  # the key of a long run that goes on

    def room(self, n, m, i, j):
        """Whether sets of n and m shingles whose first common one has places i and j in them can overlap enough."""
        overlap = 1 + np.minimum(n - i - 1, m - j - 1)
        return (100 + self.percent) * np.minimum(overlap, np.minimum(n, m)) >= self.percent * (n + m)

    def feed(self, rows: list[np.ndarray], last: bool) -> list[np.ndarray]:
        """(kind, a, b): kind 0 a pair of nodes, 1 a key (a) and a node (b); rows marked -1 are of kind 1 always."""
        key, node, packed = rows
        hot = packed < 0
        out = [(1, key[hot], node[hot])]
        rows = [key[~hot], node[~hot], packed[~hot] >> 32, packed[~hot] & 0xFFFFFFFF]
        key, node, n, place = (np.concatenate([old, new]) for old, new in zip(self.rest, rows, strict=True))
        if self.long is not None and len(key):
            same = key == self.long
            out.append((1, key[same], node[same]))
            if not same.all():
                self.long = None
            key, node, n, place = (x[~same] for x in (key, node, n, place))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        ends = np.append(starts[1:], len(key)) if len(key) else starts
        keep = len(key)
        if len(starts) and not last:
            a = int(starts[-1])
            if len(np.unique(node[a:])) > PAIRS_AT:
                self.long = int(key[a])
            else:
                keep, starts, ends = a, starts[:-1], ends[:-1]
        self.rest = [x[keep:] for x in (key, node, n, place)]
        two = starts[ends - starts == 2]
        two = two[(node[two] != node[two + 1]) & self.room(n[two], n[two + 1], place[two], place[two + 1])]
        out.append((0, np.minimum(node[two], node[two + 1]), np.maximum(node[two], node[two + 1])))
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            nodes, first = np.unique(node[a:b], return_index=True)
            if len(nodes) > PAIRS_AT:
                out.append((1, np.full(len(nodes), key[a]), nodes))
            elif len(nodes) > 1:
                i, j = np.triu_indices(len(nodes), 1)
                x, y = a + first[i], a + first[j]
                near = self.room(n[x], n[y], place[x], place[y])
                out.append((0, nodes[i[near]], nodes[j[near]]))
        return [np.concatenate([np.full(len(a), k, np.int64) for k, a, _ in out]), *(np.concatenate([o[k] for o in out]) for k in (1, 2))]


def shared_shingles(posted: DataFrame, percent: int) -> DataFrame:
    """(kind, a, b) as ``Runs`` gives them, stored. Eager."""
    def run(batches):
        import pyarrow as pa

        runs, names = Runs(percent), ["kind", "a", "b"]
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs.feed(rows, False)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs.feed([np.zeros(0, np.int64)] * 3, True)], names=names)

    dealt = posted.repartition(F.when(F.col("size_place") < 0, F.col("node")).otherwise(F.col("key"))).sortWithinPartitions("key")
    return cut_lineage(dealt.mapInArrow(run, "kind bigint, a bigint, b bigint").distinct())


class Tree:
    """Signature tree over sets ordered by size, of their ``sizes`` and bitmaps (rows of 64-bit words); level 0 has the sets themselves."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        self.levels = [(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            cut = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut),
                                np.maximum.reduceat(slack, cut)))

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level: the label that all sets below a node have, or -1."""
        out = [labels]
        while len(out[-1]) > 1:
            cut = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], cut), np.maximum.reduceat(out[-1], cut)
            out.append(np.where(low == high, low, -1))
        return out

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether any set below node a can be linked with any below node b."""
        maps, low, high, slack = self.levels[level]
        fits = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        shared = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64)
        overlap = np.minimum(np.minimum(slack[a], slack[b]) + shared, np.minimum(high[a], high[b]))
        return fits & ((100 + percent) * overlap >= percent * (low[a] + low[b]))

    def pairs(self, labels, percent: int):
        """Pairs of sets that survive a traversal of the tree against itself; ``labels()`` gives the labels by now."""
        def below(level, a, b):
            for at in range(0, len(a), 4096):
                x, y = a[at:at + 4096], b[at:at + 4096]
                known = self.uniform(labels())[level]
                keep = (known[x] < 0) | (known[x] != known[y])
                x, y = x[keep], y[keep]
                keep = self.may_link(level, x, y, percent) if len(x) else np.zeros(0, bool)
                x, y = x[keep], y[keep]
                if not len(x):
                    continue
                if level == 0:
                    yield x, y
                    continue
                n = len(self.levels[level - 1][0])
                step = np.arange(FANOUT)
                i = (x[:, None, None] * FANOUT + step[None, :, None]) + np.zeros((1, 1, FANOUT), np.int64)
                j = (y[:, None, None] * FANOUT + step[None, None, :]) + np.zeros((1, FANOUT, 1), np.int64)
                i, j = i.ravel(), j.ravel()
                keep = (i < n) & (j < n) & ((i < j) if level == 1 else (i <= j))
                yield from below(level - 1, i[keep], j[keep])

        if len(self.levels) > 1:
            yield from below(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))


def possible_links(sizes: np.ndarray, maps: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets that may be linked, by size and bitmap; of those that hang together anyway, only some."""
    order = np.argsort(sizes, kind="stable")
    root = list(range(len(sizes)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for x, y in Tree(sizes[order], maps[order]).pairs(lambda: np.array([find(k) for k in range(len(root))]), percent):
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(order[i]), int(order[j])))
    return out


def crowd_pairs(hot: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """(a, b) sets of the crowds in ``hot`` (key, node) that may be linked. Eager.

    In a crowd, bands are powers of 100 / ``percent`` in size: linked sets are in one or in neighbouring bands.
    """
    first = hot.groupBy("key").agg(F.min("node").alias("first"))
    crowds = connected(hot.join(first, "key").select("first", "node"), "first", "node")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("bigint")
    rows = crowds.join(signatures.withColumnRenamed("sa", "node"), "node").select("root", "node", "n", "bits", band.alias("own"))
    rows = rows.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    parts = rows.groupBy("root", "band").agg(F.ceil(F.count(F.lit(1)) / CELL_SETS).alias("parts"))
    rows = rows.join(parts, ["root", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    cell = F.concat_ws("/", "root", "band", F.least("part", "other"), F.greatest("part", "other"))

    def run(group):
        import pyarrow as pa

        nodes = group.column("node").to_numpy()
        bits = group.column("bits").to_pylist()
        maps = folded(bits, 8 * min(map(len, bits)))
        found = np.array(possible_links(group.column("n").to_numpy(), maps, percent), np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[found[:, 0]], "b": nodes[found[:, 1]]})

    return rows.select(cell.alias("cell"), "node", "n", "bits").groupBy("cell").applyInArrow(run, "a bigint, b bigint")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def block_links(nodes: list[str], labels: list[str], sets: list[np.ndarray], percent: int) -> list[tuple[str, str]]:
    """(label, label) that the sets of a block join."""
    order = sorted(range(len(nodes)), key=lambda k: (len(sets[k]), labels[k], nodes[k]))
    sets, names = [sets[k] for k in order], np.array([labels[k] for k in order])
    distinct, label = np.unique(names, return_inverse=True)
    out: list[tuple[str, str]] = []

    def compare(x, y):
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if label[i] != label[j] and linked(sets[i], sets[j], percent):
                out.append((str(distinct[label[i]]), str(distinct[label[j]])))
                label[label == max(label[i], label[j])] = min(label[i], label[j])

    near = np.arange(len(sets) - 1)
    compare(near, near + 1)
    if label.any():
        size = bitmap_bits(len(sets[-1]), 8)
        maps = np.stack([bitmap(s, size) for s in sets]).view(np.uint64)
        for x, y in Tree(np.array([len(s) for s in sets], np.int64), maps).pairs(lambda: label, percent):
            compare(x, y)
    return out


def joined_blocks(texts: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) pairs of labels joined inside the blocks of ``rows`` (cell, id, node, sa, sb, label); ``texts``: (id, text)."""
    texts = texts.filter(perhaps_listed(rows.select("id"))("id")).join(rows, "id").select("cell", "node", "sa", "sb", "label", "text")

    def run(group):
        import pyarrow as pa

        found: dict[str, tuple[str, np.ndarray]] = {}
        columns = [group.column(k).to_pylist() for k in range(1, 6)]
        for node, sa, sb, label, text in zip(*columns, strict=True):
            if node not in found:
                mine = shingles(text, size)
                if digest(mine) == (sa, sb):  # another text may have the same id
                    found[node] = (label, mine)
        links = block_links(list(found), [v[0] for v in found.values()], [v[1] for v in found.values()], percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.string()), "b": pa.array([b for _, b in links], pa.string())})

    return texts.groupBy("cell").applyInArrow(run, "a string, b string")


def frequent_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, times) of the most repeated shingles, FREQUENT at most: the least eighth of a power of two that leaves so few. Eager."""
    times = cut_lineage(described.filter("times is not null").groupBy("hash").agg(F.sum("times").alias("times")))
    level = F.floor(F.log2("times") * 8)
    total, least = 0, None
    for row in sorted(times.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):
        total += row["n"]
        if total > FREQUENT:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    common = times.filter(level >= least).toPandas()
    hashes = common["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], common["times"].to_numpy(np.int64)[order]


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 75, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document. Eager: writes its steps to the shared folder."""
    described = cut_lineage(describe(docs, size, id_col, text_col))
    rows = described.filter("n is not null")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(described))
    met = shared_shingles(postings(docs, frequent, size, percent, text_col), percent)
    signatures = rows.filter("n > 0").groupBy("sa").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    pairs = possible(met.filter("kind = 0").select("a", "b"), signatures, percent)
    hot = met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"))
    if not hot.isEmpty():
        pairs = pairs.unionByName(crowd_pairs(hot, signatures, percent))
    nodes = rows.filter("n > 0").groupBy("sa", "sb").agg(F.min("id").alias("id"), F.max("n").alias("n")).filter("id is not null")
    members = cut_lineage(nodes.join(families(pairs, "sa"), "sa").withColumn("node", F.concat(F.hex("sa"), F.lit("."), F.hex("sb"))))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    listed = members.select("id").distinct()
    texts = cut_lineage(texts.filter(perhaps_listed(listed)("id")).join(listed, "id", "left_semi"))
    labels = family_links(members, lambda blocks: joined_blocks(texts, blocks, size, percent))
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    component = (nodes.join(labels.join(least, "label").select("sa", "sb", "least"), ["sa", "sb"], "left")
                 .select("sa", "sb", F.coalesce("least", "id").alias("component_id")))
    found = rows.filter("n > 0").join(component, ["sa", "sb"], "left").select("id", "n", "component_id")
    return found.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
