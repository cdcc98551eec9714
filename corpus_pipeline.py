"""A training corpus from documents, stage by stage.

Classify by quality, drop exact copies, keep one document of each group of near copies, mix the sources to their
target weights, and encode what is left with a byte-level BPE. Each stage works on all rows that its predecessor
kept; all but the last return the columns of documents, and a row that the mix takes twice comes twice.

Defined results of every stage: a null text counts as an empty one and a null source as a source of its own; texts are
whole, however long; columns besides doc_id, text and source pass through as they are, whatever their names, up to the
last stage; an empty table gives an empty one with the same columns. What else is defined is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonoshelf.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality
from sonoshelf.llm.common import new_path, remove, stow, temporary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject. Rows that repeat a text stay or go together; an empty
    text is scored by the bias alone; without training rows every score is 0.5, so all go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each different text: that of the largest id, null being the smallest; one of its repeats."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more connect: that of the smallest id. Texts without
    words are one group; a row with a null id goes only if another row of its group has an id."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it. Rows with the same id share its hash, so they are taken alike; rows
    without words follow their hash too; a source without words has no target and goes."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text as numbers and digests, with the digest of what they decode to: (doc_id, n_tokens,
    ids_sha256, decoded_sha256), a row for each row; an empty text has no ids."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]
#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; every stage's rows are written and read again. What a stage writes for itself is removed
    at its end, and its input once its rows are written; the result reads the rows of the last stage but one."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        at = new_path(spark, f"stage{k}")
        with temporary(spark):
            docs = stow(stage(spark, docs, sf_dir), f"stage{k}", at=at)
        if before:
            remove(spark, [before])
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
