"""From raw documents to packed training sequences: quality, near copies, repeated passages, benchmarks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the shared checkpoint
folder and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchform.llm import bytenet, decontaminate, nearcopies, packing, substrings
from matchform.session import TEXT_SETTINGS, ensure_checkpoint_dir


def in_small_batches(stage: Callable) -> Callable:
    """The settings must hold when the stage's result is written, so they stay."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in TEXT_SETTINGS.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores at least 0.7."""
    net = bytenet.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return bytenet.kept(docs, net)


@in_small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies: five-word shingles, similarity of at least 0.8."""
    return nearcopies.representatives(docs, words=5, similarity=0.8)


@in_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that an earlier document has."""
    return substrings.without_repeats(docs)


@in_small_batches
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("packing", packed),
]

# A trained network, fingerprints and a tokenizer are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them stays in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
