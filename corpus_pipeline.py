"""From raw documents to tokens: five stages over the documents table, each written and reread."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwatch.llm.byte_bpe import encoding_digests
from netwatch.llm.common import read_table
from netwatch.llm.decontaminate import drop_contaminated
from netwatch.llm.near_dedup import drop_near_duplicates
from netwatch.llm.quality_rules import quality_filter
from netwatch.llm.secret_scan import redact_documents
from netwatch.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified rule go."""
    return quality_filter(docs, read_table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are redacted; n_chars follows the text."""
    return redact_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become byte-level BPE ids, checked by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                            tables=160_000)  # beside stages that fill the heap, smaller tables


STAGES = [("quality rules", quality), ("near dedup", dedup), ("decontamination", decontaminate),
          ("secret scan", secrets), ("byte bpe", tokens)]

#: Cutoffs, sketches and byte-level codes are not expressible as SQL over the tables; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage{number + 1}")
    return docs
