"""The corpus pipeline: stages that filter and rewrite documents, each written and read again by the next.

Every stage but the last returns the columns of documents. Null texts pass the filters: there is nothing to judge.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.llm import decontaminate, neardup, quality, queries, sentence_pieces, substrings
from tallyrank.llm.common import fresh, table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality ranking puts below its cut."""
    (score,) = fresh(docs, "score")
    scored = quality.score(docs, queries.quality_model(spark, sf_dir), name=score)
    return scored.where(F.col("text").isNull() | (F.col(score) >= queries.QUALITY_THRESHOLD)).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near duplicates."""
    return neardup.deduplicated(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words or more out of all documents but the first that has them."""
    return substrings.cleaned(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), cleaned=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, starts, ends: the pieces of each text with their byte spans."""
    return sentence_pieces.encode(docs, public_tokenizers.path(queries.PIECE_MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("repeated_passages", unrepeated),
    ("decontaminate", uncontaminated),
    ("sentence_pieces", encoded),
]

#: The stages rank, sketch and tokenize: tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
