"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

1. Quality rules: documents that the rules reject go.
2. Line dedup: repeated lines go; a document that loses all its lines goes with them.
3. N-gram Jaccard join: the first document of each group stays.
4. Benchmark decontamination: documents that hold a benchmark window go.
5. Best-fit packing: the rest as sequences of tokens.

All stages but the last give the columns of ``documents``. Every stage works on empty tables,
nulls and repeated rows as its operator's docstring says. In stage 3 rows with equal id and equal
text are one document, and rows without id that differ in text stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import decontamination, line_dedup, packing, quality_rules, set_join
from pitpanel.llm.common import table
from pitpanel.llm.queries import BYTE_MODEL, tokenizer_file
from pitpanel.session import cut_lineage


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return quality_rules.apply_rules(docs, trusted).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, n_chars counted anew."""
    left = line_dedup.remove_lines(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    gone = set_join.near_duplicates(docs).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as sequences of 2048 tokens, a row for each piece."""
    return packing.pack(docs, tokenizer_file(BYTE_MODEL))


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Log-likelihood ratios, SimHash groups and the packing have no SQL twin; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each stage's rows written as a table first."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
