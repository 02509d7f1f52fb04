"""A corpus pipeline of five training-data operators: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from impactlens.llm import exact_dedup, language_id, packing, secret_scan, simhash
from impactlens.llm.queries import BYTE_LEVEL
from impactlens.storage import new_path


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are in none of the languages learned from the labelled rows go; missing labels are filled in."""
    return language_id.known_language(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the smallest id stays."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id stays."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside the texts are masked; no row goes."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, each a training sequence of a binary length."""
    return packing.pack_powers(docs, BYTE_LEVEL)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", known_languages),
    ("exact copies", without_copies),
    ("near copies", without_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

# A learned language model, votes over hashes and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each one's result written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "corpus")
    for number, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{path}/{number}")
        docs = spark.read.schema(done.schema).parquet(f"{path}/{number}")
    return docs
