"""The corpus pipeline: quality classifier, near-duplicate removal, secret redaction, source mixing, tokens.

Each stage gets the session, the documents that the stage before it kept, and the folder of tables, and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage as Parquet in the shared folder and rereads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, knnvote, mixing, secrets, similar
from touchline.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote takes for good; the rest go."""
    return knnvote.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group: fingerprints within two bits, or five-word likeness of 0.8."""
    return similar.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of text."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("secret scans", redact_secrets), ("mixing", mix), ("byte-level BPE", tokens)]

#: SQL can express neither the classifier's model nor the tokenizer. Tests hold the later stages against brute force; the first only against its operator, and that by held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
