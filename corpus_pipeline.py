"""A corpus pipeline: toxicity, SimHash near-dedup, secret scans, source mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, whatever further columns they have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, mixing, queries, secret_scan, simhash, toxicity
from barloom.session import forget, shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores under 0.5.

    Null and empty texts score as the classifier's bias; repeated rows all stay or all go. No labels: all stay.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Null, empty and blank texts are one group; null doc_ids come after all others; of rows that
    repeat a doc_id one a group stays.
    """
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets, n_chars made to fit. Null texts stay null."""
    return secret_scan.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole texts, by training time.

    A null source is a source of its own; texts without words are not taken; every repeated row counts.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them, one row a row; null texts count as empty."""
    return bpe.digests(docs, queries.byte_bpe_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("bpe", encode),
]

#: A fitted classifier and fixpoints over fingerprints are beyond SQL; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again.

    A stage's folder is deleted when the next one's is written; the last stage reads the one that is left.
    """
    folder = f"{shared_folder(spark)}/barloom-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                forget(spark, f"{folder}/{k - 1}")
    return docs
