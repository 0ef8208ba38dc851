"""The pipeline on nulls, repeated rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline

GOOD = " ".join(f"ordinary{k % 60} words{k % 7} about thing{k} stand{k % 11}" for k in range(40))


def tables(spark, folder, docs, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_on_awkward_tables(spark, tmp_path, empty):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_id string, kept string"
    leak = "the benchmark asks for exactly these eleven words in this order"
    texts = [(1, GOOD), (2, None), (3, ""), (4, GOOD + "\nan own line that nothing else has at all"), (5, GOOD), (5, GOOD), (None, None),
             (6, " ".join(f"leaky{k} text{k % 13}" for k in range(60)) + "\n" + leak), (7, " ".join(f"clean{k} other{k % 17}" for k in range(60)))]
    docs = spark.createDataFrame([(k, t, None, "s", len(t or ""), "r", "k") for k, t in texts], schema)
    labels = spark.createDataFrame([(k, 1, 0) for k in (1, 4, 5, 6, 7)] + [(3, 0, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, leak), (2, None), (None, "")], "item_id bigint, text string")
    if empty:
        docs, labels, bench = docs.limit(0), labels.limit(0), bench.limit(0)
    folder = tables(spark, tmp_path, docs, labels, bench)
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    if empty:
        assert not rows
    else:
        assert ids == {1, 4, 7}
