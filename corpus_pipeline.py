"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontamination, pieces, quality, secrets, simhash
from palimpsest.llm.common import arrow_batches, cut, table

#: Where the vocabulary of the last stage lies.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    arrow_batches(spark)
    model = quality.train(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "quality")
    return quality.accepted(docs, "text", model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    arrow_batches(spark)
    return simhash.one_of_each(docs, "doc_id", "text")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in passages of the benchmark."""
    return decontamination.clean(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redacted(docs, "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents with ids (of pieces), ends (the source byte where each piece ends) and decoded (the text that the ids stand for)."""
    arrow_batches(spark)
    return pieces.encode(docs, "text", MODEL, docs.columns)


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", tokens),
]

#: No SQL expresses a fitted rule ensemble or a piece vocabulary; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
