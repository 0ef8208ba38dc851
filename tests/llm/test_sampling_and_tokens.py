"""Resampling, alignment of tokenizers and language identification against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from pitpanel.llm import alignment, byte_bpe, language_id, resampling
from pitpanel.llm.queries import BYTE_MODEL, PIECE_MODEL, tokenizer_file

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
ODD = [None, "", "a", "é ü", "▁ mark", "x\ny\tz", "  two  spaces ", "<|endoftext|> and <s> </s> <0x0A>", "日本語 text 🎉", "word " * 40, " ", "\x00\x01"]


# 11: resampling

def brute_resample(rows, target, n_buckets=10_000, seed=2024, percent=10, least=20):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(resampling.LOWER)) for _, t in rows]
    bucket = [[zlib.crc32(w.encode()) % n_buckets for w in ws] for ws in words]
    s, t = collections.Counter(b for bs in bucket for b in bs), collections.Counter()
    for text in target:
        t.update(zlib.crc32(w.encode()) % n_buckets for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(resampling.LOWER)))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for (key, _), bs in zip(rows, bucket, strict=True):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + n_buckets) / ((s[b] + 1) * (total_t + n_buckets)))) for b in bs)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    places = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(places[:len(places) * percent // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_resampling_equals_brute_force(spark, small):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(["Alpha", "beta", "GAMMA", "é", "x1", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    rows += [(7, rows[7][1])] * 90 + [(None, rows[9][1])] * 3 + [(k, t) for k, t in enumerate(ODD, 900)]
    target = ["alpha beta beta", None, "", "w3 W4 w5", "é"]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, rank string, segment int").repartition(7)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    draw = resampling.Draw(percent=60, segment_rows=20, least_segments=1, most_segments=9, samples=3) if small else resampling.Draw(percent=60)
    out = resampling.resample(docs, bench, draw=draw).collect()
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out), key=repr)
    assert got == brute_resample(rows, target, percent=60)


def test_resampling_without_rows_or_target(spark, awkward, nothing):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(nothing, none).count() == 0
    out = resampling.resample(awkward, none).collect()
    assert len(out) == awkward.count() and all(r["rank"] is None for r in out)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out), key=repr) == brute_resample(rows, [])


def test_features_are_runs_of_words():
    assert resampling.features("A b-c", 2) == (3, ["a", "b", "c", "a b", "b c"])


# 12: alignment

def brute_alignment(texts):
    known = alignment.Tokenizers(tokenizer_file(BYTE_MODEL), tokenizer_file(PIECE_MODEL))
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer_file(BYTE_MODEL))
    plain.encode_special_tokens = True
    docs = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = known.b.encode(text) if text else []
        if b"".join(known.a_bytes[x] for x in a) != whole or b"".join(known.b_bytes[x] for x in b) != whole:
            a, b = [], []
        owners, ends = [], []
        for ids, table in ((a, known.a_bytes), (b, known.b_bytes)):
            owners.append([k for k, x in enumerate(ids) for _ in table[x]])
            ends.append(set(np.cumsum([len(table[x]) for x in ids]).tolist()))
        pairs = [(a[i], b[j]) for i, j in sorted(set(zip(*owners)))]
        groups, at = [], 0
        for cut in sorted(ends[0] & ends[1]):
            groups.append([[ids[k] for k in sorted(set(own[at:cut]))] for ids, own in zip((a, b), owners)])
            at = cut
        docs.append((len(a), len(b), pairs, groups))
    counts = collections.Counter(p for d in docs for p in d[2])
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for n_a, n_b, pairs, groups in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs),
                    hashlib.sha256(text.encode()).hexdigest() if text else "", sum(len(x) * len(y) for x, y in groups)))
    return out


@pytest.mark.parametrize("hot_pairs", [0, 5, 1 << 20])
def test_alignment_equals_brute_force(spark, hot_pairs):
    rng = random.Random(12)
    texts = ODD + ["".join(rng.choice(["un", "believ", "able", " ", " ", "\n", "é", "123", "token", "isation", "▂", "'s", ".", "Z", "  "]) for _ in range(60))
                   for _ in range(40)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, n_a int").repartition(3)
    files = alignment.Files(tokenizer_file(BYTE_MODEL), tokenizer_file(PIECE_MODEL))
    out = alignment.alignments(docs, files, hot_pairs=hot_pairs).orderBy("doc_id").collect()
    got = [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_group_links) for r in out]
    assert got == brute_alignment(texts)
    for kind, column in (("overlap", 3), ("group", 7)):
        assert alignment.links(docs, files, kind=kind).count() == sum(r[column] for r in got)


def test_alignment_of_pieces_and_awkward_rows(spark, awkward, nothing, monkeypatch):
    files = alignment.Files(tokenizer_file(BYTE_MODEL), tokenizer_file(PIECE_MODEL))
    rows = awkward.collect()
    want = collections.Counter(zip([r.doc_id for r in rows], brute_alignment([r.text for r in rows])))
    out = alignment.alignments(awkward, files).collect()
    assert collections.Counter((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_group_links)) for r in out) == want
    assert alignment.alignments(nothing, files).count() == 0
    known, text = alignment.Tokenizers(files.a, files.b), "It's a test, of many (small) pieces 12 34 é ü."
    whole = known.encode(text)
    monkeypatch.setattr(alignment, "PIECE_CHARS", 5)
    assert all(np.array_equal(x, y) for x, y in zip(known.encode(text), whole))


def test_products_of_sparse_matrices_equal_dense(monkeypatch):
    rng = np.random.default_rng(13)
    for entries in (5, 1 << 20):
        monkeypatch.setattr(alignment, "STEP_ENTRIES", entries)
        for shape in ((4, 6, 5), (0, 3, 2), (3, 0, 2), (7, 4, 1)):
            dense = [rng.integers(0, 3, shape[:2]) * rng.integers(0, 2, shape[:2]), rng.integers(0, 3, shape[1:]) * rng.integers(0, 2, shape[1:])]
            parts = []
            for m in dense:
                row, col = np.nonzero(m)
                parts.append(alignment.CSR(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(m)))]), col, m[row, col], m.shape[1]))
            found, out = alignment.product(*parts), np.zeros((shape[0], shape[2]), int)
            out[alignment.row_numbers(found), found.col] = found.val
            assert np.array_equal(out, dense[0] @ dense[1])
            assert np.array_equal(alignment.transposed(alignment.transposed(parts[0])).col, parts[0].col)


def test_byte_pairs_equal_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_file(BYTE_MODEL)), byte_bpe.ByteLevelBPE(tokenizer_file(BYTE_MODEL))
    rng = random.Random(14)
    parts = ["a", " ", "  ", " " * 5000, "\n" * 4097, "é", "<|endoftext|>", "'s", "\x1c", " ", " 12", "!", "\t", "̀", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xE0000, 0xE0080)]
    texts += ["".join(f" {c}{c}a{c} " for c in every[k:k + 512]) for k in range(0, len(every), 512)]
    for special in (True, False):
        library.encode_special_tokens = not special
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert (own.ids if special else own.plain)(text).tolist() == want.ids, text[:80]


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with open(tokenizer_file(BYTE_MODEL), encoding="utf-8") as f:
        parts = json.load(f)
    merges = parts["model"]["merges"]
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": parts["model"] | {"merges": merges[1:2] + merges[:1] + merges[2:]}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(parts | change), encoding="utf-8")
        with pytest.raises(ValueError):
            byte_bpe.ByteLevelBPE(str(path))


# 13: languages

def test_language_by_compression(spark, awkward, nothing):
    rng = random.Random(15)
    stems = {"aa": ["kalo", "mira", "tenu", "sopa"], "bb": ["strag", "vlomp", "krint", "zwelt"], "cc": ["øse", "ålm", "næro", "ødig"]}
    rows = [(k, " ".join(rng.choice(stems[lang]) + rng.choice(["", "s", "ti"]) for _ in range(rng.randint(4, 300))), lang)
            for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "12 34 --", "bb"), (902, rows[0][1], None), (None, "strag vlomp krint", "bb"), (903, rows[1][1].upper() * 50, "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs.filter(~language_id.in_fold("doc_id", 4, 2)))
    assert sorted(model.languages) == ["aa", "bb", "cc"] and all(len(c) <= model.settings.dict_bytes for c in model.contents)
    out = language_id.identify(docs, model).collect()
    assert len(out) == len(rows)
    for row, (key, text, lang) in zip(sorted(out, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))):
        assert row.held_out == (key is not None and zlib.crc32(str(key).encode()) % 4 == 2) and 0 <= row.score <= 1
        if not text or not any(map(str.isalpha, text)):
            assert (row.lang_pred, row.score) == ("und", 0)
        elif lang:
            assert row.lang_pred == lang
    assert all(r.lang_pred == "und" for r in language_id.identify(awkward, language_id.fit(nothing.withColumn("lang", nothing.extra))).collect())
    assert language_id.identify(nothing, model).count() == 0
    with pytest.raises(ValueError):
        language_id.fit(docs, settings=language_id.Settings(max_languages=2))


def test_every_block_of_a_text_counts_and_narrow_margins_are_marked():
    model = language_id.Model(["aa", "bb"], [b" kalo mira tenu sopa " * 20, b" strag vlomp krint zwelt " * 20], language_id.Settings())
    encoders = model.encoders()
    start = "kalo mira tenu sopa " * 200
    assert model.judge(model.sizes(start, encoders))[0] == "aa"
    rest = " ".join(random.Random(16).choices(["strag", "vlomp", "krint", "zwelt"], k=9000))
    assert model.judge(model.sizes(start + rest, encoders))[0] == "bb"
    lang, score, margin = model.judge(model.sizes("qqqq", encoders))
    assert lang == "aa" and margin < model.settings.min_margin and 0.4 < score < 0.6


@needs_tables
def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.in_fold("doc_id", 4, 2)))
    out = language_id.identify(docs, model).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang_pred != 'und'").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    kept = [r for r in out if not r.rejected]
    assert len(kept) > 0.95 * len(out) and np.mean([r.lang_pred == r.lang for r in kept]) >= np.mean([r.lang_pred == r.lang for r in out])
