"""The registered queries ``opN_<name>``: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitpanel.llm import (alignment, decontamination, html_text, language_id, line_dedup, packing, personal_data, quality_classifier,
                          quality_rules, resampling, secrets, set_join, token_counts)
from pitpanel.llm.common import table

#: Tokenizer files by name in the public tokenizer folder; another folder is a parameter of the operators.
PIECE_MODEL, BYTE_MODEL = "piece_bpe_32k.model", "byte_bpe_50k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
        FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS l FROM (SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[i + 1:i + l], ' ') AS s
       FROM (SELECT item_id, w, l, unnest(range(len(w) - l + 1)) AS i FROM b)),
dw AS (SELECT k, l, i, array_to_string(w[i + 1:i + l], ' ') AS s
       FROM (SELECT k, w, l, unnest(range(len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
hits AS (SELECT k, l, i, s FROM dw WHERE s IN (SELECT s FROM iw)),
nh AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + l)) AS p FROM hits) GROUP BY k),
ni AS (SELECT k, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items
       FROM (SELECT k, CAST(item_id AS VARCHAR) AS item FROM hits JOIN iw USING (s)) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(nh.n, 0) AS n_hit, coalesce(ni.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (k) LEFT JOIN ni USING (k)
"""


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data.find_personal_data(docs, personal_data.fit(docs))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_MODEL))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_MODEL))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"), trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "ratio", "kept")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + least(5, len(w))], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(len(w) - least(5, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 75 * (a.n + b.n - m)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (SELECT 0 AS side, doc_id, row_number() OVER () AS k, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
      UNION ALL
      SELECT 1, NULL, 0, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) FROM benchmark),
f AS (SELECT side, k, word, count(*) AS n FROM (SELECT side, k, unnest(w) AS word FROM w) GROUP BY ALL),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM f)),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2),
        lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
        lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM h, crc),
c AS (SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t
      FROM f JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT CAST(sum(s) AS DOUBLE) FROM c) + 10000)
        / ((CAST(s AS DOUBLE) + 1) * ((SELECT CAST(sum(t) AS DOUBLE) FROM c) + 10000)))) AS BIGINT) AS gain FROM c),
d AS (SELECT k, sum(n * gain) AS weight FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY k),
u AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, list_reduce(list_prepend(0, list_transform(range(8),
        lambda i: instr('0123456789abcdef', sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[i + 1]) - 1)), lambda a, v: 16 * a + v) AS h
      FROM w LEFT JOIN d USING (k) WHERE side = 0),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) OVER (PARTITION BY n_features >= 20) AS enough FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * enough // 100 THEN place END AS rank FROM r
"""


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = alignment.Files(tokenizer_file(BYTE_MODEL), tokenizer_file(PIECE_MODEL))
    return alignment.alignments(table(spark, sf_dir, "documents"), files)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs.filter(~language_id.in_fold("doc_id", 4, 2))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_winnowing_decontamination, op2_personal_data, op3_token_counts, op4_best_fit_packing, op5_quality_rules,
        op6_secret_scans, op7_signature_tree_join, op8_html_extraction, op9_quality_classifier,
        op10_line_dedup, op11_importance_resampling, op12_tokenizer_alignment, op13_language_id,
    )
}

SQL: dict[str, str] = {"op1_winnowing_decontamination": OP1_SQL, "op7_signature_tree_join": OP7_SQL,
                       "op11_importance_resampling": OP11_SQL}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries above and the pipeline of ``corpus_pipeline.py``."""
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}
