"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, html_text, media, mixing, paragraphs, quality, secret_scan, simhash, sql, syncmers, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_probe(documents(spark, sf_dir))


def byte_bpe_path() -> str:
    """The public byte-level vocabulary, where its package keeps it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op3_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


def op4_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), byte_bpe_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(documents(spark, sf_dir))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.probe(documents(spark, sf_dir))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixing.in_training_order(mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "position_2"))


def queries() -> dict:
    return {
        "op1_syncmer_fingerprints": op1_syncmer_fingerprints,
        "op2_secret_scan": op2_secret_scan,
        "op3_simhash_classes": op3_simhash_classes,
        "op4_trie_bpe": op4_trie_bpe,
        "op5_quality": op5_quality,
        "op6_paragraph_dedup": op6_paragraph_dedup,
        "op7_html_text": op7_html_text,
        "op8_toxicity": op8_toxicity,
        "op9_avi_media": op9_avi_media,
        "op10_curriculum_mix": op10_curriculum_mix,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
