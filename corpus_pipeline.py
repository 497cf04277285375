"""A corpus from documents: quality classifier, line dedup, near duplicates, repeated sentences, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import common, lines, packing, quality, shingles, spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, trained on the labelled ones among them."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines once in the corpus; every document stays, if only as an empty text."""
    return _as_documents(lines.dedup_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one document, the one with the smallest id."""
    return shingles.first_of_groups(docs).select(*COLUMNS)


def dedup_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of sentences once in the corpus; every document stays."""
    return _as_documents(spans.drop_spans(docs, spans.PASSAGES))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 4096 tokens."""
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES = [
    ("quality", keep_quality),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("sentences", dedup_sentences),
    ("packing", pack),
]

#: No SQL: a trained network, SimHash and a tokenizer take part. tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
