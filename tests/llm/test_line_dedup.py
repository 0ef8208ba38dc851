"""Line dedup: recall against brute force by length and edit, frequent blocks, column names."""

import random
import re

import numpy as np
import pytest

from pitpanel.llm import families, line_dedup, line_keys

LETTERS = "abcdefghijklmnopqrstuvwxyz"
LENGTHS = (4, 5, 6, 7, 8, 10, 12, 13, 15, 18, 20, 30, 40, 60, 80)


def word(rng, n=None):
    return "".join(rng.choice(LETTERS) for _ in range(n or rng.randint(2, 9)))


def edited(rng, words, kind):
    words, at = list(words), rng.randrange(len(words))
    old = words[at]
    if kind == "word":
        words[at] = word(rng, len(old))
    elif kind == "letter":
        k = rng.randrange(len(old))
        words[at] = old[:k] + rng.choice(LETTERS) + old[k + 1:]
    elif kind == "lost letter":
        words[at] = old[1:] if len(old) > 2 else old + "x"
    elif kind == "added word":
        words.insert(at, "ab")
    elif kind == "every twelfth word":
        for at in rng.sample(range(len(words)), max(1, len(words) // 12)):
            words[at] = word(rng, len(words[at]))
    return words


@pytest.mark.parametrize("kind", ["word", "letter", "lost letter", "added word", "every twelfth word"])
def test_similar_lines_are_found_at_every_length(spark, kind):
    # Brute force: line 2k and 2k + 1 are within 90 %, if they are alike at all, and no others are.
    rng, rows, wanted = random.Random(kind), [], {}
    for n in LENGTHS:
        wanted[n] = []
        for _ in range(4000):
            line = [word(rng) for _ in range(n)]
            a, b = " ".join(line), " ".join(edited(rng, line, kind))
            if a != b and line_dedup.alike(a, b, 90):
                wanted[n].append(len(rows) + 1)
                rows += [(len(rows), a), (len(rows) + 1, b)]
            if len(wanted[n]) == 20:
                break
    gone = {r.doc_id for r in line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("n_removed > 0").collect()}
    assert gone <= {k for keys in wanted.values() for k in keys}
    for n, keys in wanted.items():
        assert len(keys) < 5 or len(gone & set(keys)) >= 0.9 * len(keys), (n, kind)


def brute_groups(lines):
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if label[i] != label[j] and line_dedup.alike(lines[i], lines[j], 90):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("often", [False, True])
def test_frequent_blocks_lose_no_link(spark, monkeypatch, often):
    # All lines share a block; they are alike in chains, in stars, or not at all.
    if often:
        monkeypatch.setattr(line_dedup, "SHARE", 10**9)
        monkeypatch.setattr(line_dedup, "TASK_SHARE", 10**9)
        monkeypatch.setattr(families, "BLOCK_ROWS", 7)
    rng, lines = random.Random(3), []
    for _ in range(12):
        rest = [word(rng, 6) for _ in range(24)]
        for _ in range(8):
            lines.append(" ".join(["these six words begin all lines"] + rest))
            rest[rng.randrange(24)] = word(rng, 6)
    want = brute_groups(lines)
    rng_order = rng.sample(range(len(lines)), len(lines))
    docs = spark.createDataFrame([(k, lines[k]) for k in rng_order], "doc_id bigint, text string").repartition(5)
    left = {r.doc_id for r in line_dedup.remove_lines(docs).collect() if not r.n_removed}
    assert left == {k for k in range(len(lines)) if want[k] == k}


def test_many_pairs_at_once_equal_one_by_one(monkeypatch):
    rng = random.Random(9)
    xs, ys = [], []
    for _ in range(3000):
        a = [rng.choice("ab é") for _ in range(rng.choice([0, 1, 3, 12, 40, 41, 90]))]
        b = list(a)
        for _ in range(rng.randint(0, 1 + len(a) // 6)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        xs.append("".join(a))
        ys.append("".join(b))
    want = [line_dedup.edit_within(x, y, (100 - p) * max(len(x), len(y)) // 100) for p in (90, 70) for x, y in zip(xs, ys)]
    assert 0.2 < np.mean(want) < 0.95
    for few, cells in ((1, 1 << 21), (12, 300)):
        monkeypatch.setattr(line_dedup, "FEW_PAIRS", few)
        monkeypatch.setattr(line_dedup, "BATCH_CELLS", cells)
        assert [bool(v) for p in (90, 70) for v in line_dedup.alike_many(xs, ys, p)] == want


def test_counts_never_drop_alike_lines():
    rng = random.Random(8)
    for _ in range(400):
        a = "".join(rng.choice("abc é日") for _ in range(rng.randint(1, 80)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        b = "".join(b)
        counts = line_dedup.pair_counts([a, b, ""])
        may = line_dedup.may_be_alike(counts[:1], counts[1:2], np.array([max(len(a), len(b))]), 90)[0]
        assert may or not line_dedup.alike(a, b, 90)


def test_columns_of_any_name_stay(spark):
    rows = [(1, "one line of text here\nand another one", "k", 7, [1], 2), (2, "and another one\nown", "m", 8, None, 3), (None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, row_id string, row_key bigint, gone array<int>, n_removed int, `a.b` string"
    docs = spark.createDataFrame([(*r, "x") for r in rows], schema)
    out = {r.doc_id: r for r in line_dedup.remove_lines(docs).collect()}
    assert (out[1].row_id, out[1].row_key, out[1].gone, out[1].n_removed, out[1]["a.b"]) == ("k", 7, [1], 0, "x")
    assert (out[2].text, out[2].row_key, out[2].n_removed) == ("own", 8, 1) and out[None].text is None
    named = line_dedup.remove_lines(docs.drop("doc_id"), id_col="row_id").collect()
    assert sorted(r.n_removed for r in named) == [0, 0, 1]


def test_normal_lines_equal_the_plain_rule():
    def plain(line):
        return re.sub(r"\d+", "0", " ".join(re.findall(r"[^\W_]+", line.lower())))

    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B", " ", "_", "é", "É", "7", "00", "-", "\t", "\x1c", "\n", "İ", "²", "٣", "ß", "日"]) for _ in range(rng.randint(0, 14)))
        assert [x.decode() for x in line_keys.normal_lines(text)] == [plain(x) for x in text.split("\n")]


def test_simhash_bits_are_those_of_most_words():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 4, 6, 7, 13):
        words = rng.integers(0, 1 << 63, (20, width)).astype(np.uint64)
        bits = (words[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        want = (2 * bits.sum(axis=1) > width).astype(np.uint64)
        assert np.array_equal((line_keys.majority(words)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), want)


def test_runs_give_the_same_at_any_batch_size():
    rng = np.random.default_rng(6)
    key = np.sort(rng.integers(0, 30, 600))
    key[200:320] = key[200]
    key = np.sort(key)
    rows = [key, rng.integers(0, 400, 600), rng.integers(50, 60, 600)]
    rows[2] = 50 + rows[1] % 10
    got = set()
    for size in (1, 7, 1000):
        runs, found = line_dedup.Runs(90), []
        for at in range(0, 600, size):
            found.append(np.stack(runs.feed([x[at:at + size] for x in rows], False)))
        found.append(np.stack(runs.feed([x[:0] for x in rows], True)))
        got.add(frozenset(map(tuple, np.concatenate(found, axis=1).T.tolist())))
    assert len(got) == 1 and {row[0] for row in next(iter(got))} == {0, 1}


def test_quick_ways_never_differ_from_the_edit_distance():
    # Most alike lines need no table, and long lines of other words are dropped by their runs.
    rng, quick, dropped = random.Random(12), 0, 0
    for n in (20, 60, 200, 400):
        for _ in range(12):
            a = [word(rng) for _ in range(n)]
            b = list(a)
            for k in rng.sample(range(n), rng.randint(1, n // 8)):
                b[k:k + rng.randint(0, 1)] = rng.choice([[], [word(rng)], [word(rng), word(rng)]])
            a, b = " ".join(a), " ".join(b)
            other = " ".join(word(rng) for _ in range(n))[:len(a)]
            limit = max(len(a), len(b)) // 10
            want = line_dedup.edit_within(a, b, limit)
            found = line_dedup.few_differences(*line_dedup.middles(a, b), limit)
            assert want or not found
            runs = [line_dedup.runs_of(x) for x in (a, b, other)]
            assert not want or max(line_dedup.absent(*runs[:2]), line_dedup.absent(*runs[1::-1])) <= line_dedup.RUN * limit
            quick += want and found
            dropped += line_dedup.absent(runs[0], runs[2]) > line_dedup.RUN * (max(len(a), len(other)) // 10)
            assert line_dedup.alike_many([a, b, a], [b, a, other], 90).tolist() == [want, want, line_dedup.alike(a, other, 90)]
    assert quick >= 10 and dropped >= 40
    assert not line_dedup.few_differences("", "ab", 1) and line_dedup.few_differences("", "ab", 2)


def test_blocks_are_the_same_in_batches_of_any_size(monkeypatch):
    rng = random.Random(13)
    lines = [" ".join(word(rng) for _ in range(rng.randint(1, 30))).encode() for _ in range(300)]
    want = line_keys.block_keys(lines, 10)
    monkeypatch.setattr(line_keys, "USUAL", 64)
    got = line_keys.block_keys(lines, 10)
    assert all(np.array_equal(x, y) for x, y in zip(want, got, strict=True))


def test_lines_that_meet_in_an_earlier_block_are_not_compared_again():
    lines = ["one line of text that two blocks share", "one line of text that two blocks sharf", "one line of text that two blocks shark"]
    counts = line_dedup.pair_counts(lines)
    assert len(line_dedup.group_links([1, 2, 3], lines, counts, 90)) == 2
    assert line_dedup.group_links([1, 2, 3], lines, counts, 90, [[5], [5], []]) == [(1, 3), (2, 1)]
    assert line_dedup.group_links([1, 2, 3], lines, counts, 90, [[5, 7], [6, 7], [5, 6]]) == []


def test_cells_compared_together_give_the_groups_of_cells_alone(monkeypatch):
    rng, lines, cells = random.Random(21), [], []
    for _ in range(30):
        start, rest = len(lines), [word(rng, 6) for _ in range(20)]
        for _ in range(rng.choice([2, 9, 50])):
            lines.append(" ".join(rest))
            rest[rng.randrange(20)] = word(rng, 6)
        cells.append((start, len(lines)))
    want, calls, compare = [], [], line_dedup.alike_many
    for low, high in cells:
        want += [low + label for label in brute_groups(lines[low:high])]
    monkeypatch.setattr(line_dedup, "alike_many", lambda xs, ys, *more: calls.append(len(xs)) or compare(xs, ys, *more))
    counts = line_dedup.pair_counts(lines)
    for most in (10**6, 50):
        monkeypatch.setattr(line_dedup, "OPEN_PAIRS", most)
        got = list(range(len(lines)))
        for a, b in line_dedup.cells_links(cells, list(range(len(lines))), lines, counts, 90):
            low, high = sorted((got[a], got[b]))
            got = [low if x == high else x for x in got]
        assert got == want
        if most > 50:  # a few rounds for all cells, and far fewer pairs than there are
            assert len(calls) < 50 and sum(calls) < sum((high - low) * (high - low - 1) // 2 for low, high in cells) // 2


def test_lines_that_stand_once_alone_are_not_carried_on(spark):
    lines = spark.createDataFrame([(1, 9, 0, 5, 6), (2, 9, 0, 5, 6), (2, 9, 1, 5, 7), (3, 9, 0, 8, 8), (4, 9, 0, 10, 1), (4, 9, 1, 11, 1)],
                                  "row_id bigint, row_key bigint, no int, la bigint, lb bigint")
    groups = spark.createDataFrame([(10, 10), (11, 10)], "la bigint, label bigint")
    rows = line_dedup.repeated_lines(lines, groups).collect()
    assert sorted((r.row_id, r.no) for r in rows) == [(1, 0), (2, 0), (4, 0), (4, 1)]
    assert len({r.group for r in rows}) == 2
