"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, token ids.

Each stage works on all that the one before kept. The first four return the columns of documents; the last returns each
remaining document's token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plazaflow.llm import bpe, decontaminate, quality, secrets, simhash
from plazaflow.llm.common import remove, shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, does not reject.

    Rows and columns stay as they are. A null text is scored as an empty one, each of repeated rows alike; without labels
    of either kind all rows score their share: all stay if there are no labels.
    """
    return quality.drop_rejected(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, whole: that with the smallest id, without any the one with the least hash.

    Null and empty texts are near-duplicates of one another; rows that share an id are one group.
    """
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item, rows and columns as they are. Null and empty texts leak nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts masked; null texts stay null."""
    return secrets.redact(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: its token ids, decoded again. A null text has no ids."""
    import public_tokenizers

    return bpe.encode(docs, bpe.shipped(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_level_bpe", byte_level_bpe),
]

#: Neither the network nor the encoder can be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last keeps is written as Parquet to the shared folder and read again.
    What a stage has read is removed once its own output is there; the last one's input stays, as the result reads it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
