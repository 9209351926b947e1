"""Corpus pipeline: quality, exact copies, near copies, mixing, tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from shelfloom.llm.storage import passing, shared_dir
from shelfloom.sources.files import delete_tree


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents, accepts."""
    return quality.keep_good(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (runs of five words, similarity of 0.8)."""
    return near_dedup.drop_near_copies(docs, shingle_words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the last time perhaps in part and then whole; not taken ones go."""
    return mixing.repeat_taken(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row's text."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage staged goes with it, and so does its input."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with passing(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if last:
            delete_tree(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return docs
