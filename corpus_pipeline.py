"""Corpus pipeline: stages applied in order, each written as Parquet and reread as the next one's documents.

SQL cannot express a trained classifier, a connected component or a tokenizer, so there is no
ORACLE_SQL; tests/llm hold the stages against brute force on small tables.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import decontaminate, sentencepiece_codec, simhash, suffix_dedup, toxicity
from papyrine.llm.common import materialise, table
from papyrine.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity reaches the rejection threshold go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out_col="__severity__")
    return scored.filter(~toxicity.is_rejected(F.col("__severity__"))).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more over five-word shingles stays."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 that start more than once go; n_chars follows the new text."""
    left = suffix_dedup.rewrite(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else left


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: digests per document.

    Workers remember fewer words than they could alone: executors come from the stages before with a
    grown heap and other workers.
    """
    found = sentencepiece_codec.encode_decode_digests(docs.select("doc_id", "text"), tokenizer_path(), cache_words=100_000)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
