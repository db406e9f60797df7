"""A corpus pipeline: language, repeated lines, near copies, benchmark passages, packing.

Belongs to the subpackage flowgraph.llm and is removed with it. Each stage takes (spark, docs, sf_dir), works on all
rows of docs and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgraph.llm import decontaminate, langid, linededup, queries, simhash
from flowgraph.llm.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (operator 7). Those without a letter, and those in doubt, go."""
    return langid.keep_identified(docs, langid.train(docs.where(queries.LANGUAGE_TRAINING))).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand in an earlier one (operator 5); n_chars is counted anew.

    A document of which no line is left goes: all of it stands elsewhere.
    """
    cut = linededup.delete_repeated_runs(docs)
    kept = cut.where("n_deleted < n_lines or n_deleted = 0")
    return kept.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies (operator 9): five-word shingles, similarity 0.8 or more, confirmed on the full sets."""
    return simhash.keep_one_copy(docs).select(COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item (operator 1)."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens (operator 2)."""
    return queries.packed_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_tokens),
]

#: Trained models, fingerprints and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again as the next one's input."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
