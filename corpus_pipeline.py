"""A training corpus from the documents table in five stages.

Quality rules reject documents; SimHash keeps one of each group of near copies; repeated
passages are cut; documents with benchmark passages go; what is left becomes piece ids.  All
stages but the last return the columns of documents.  Each stage begins with the memory that
those before it have left behind given back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontaminate, pieces, quality, simhash, substrings
from pagemill.llm.store import forget, load, saved

#: The SentencePiece model of the last stage.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def afresh(stage: Stage) -> Stage:
    """``stage``, with what earlier stages have left in memory given back first."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark)
        return stage(spark, docs, sf_dir)

    return run


@afresh
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the limits or the classifier reject go."""
    return quality.good(docs, load(spark, sf_dir, "labels"))


@afresh
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with five-word shingle sets at 0.8 or more, the one with the least doc_id stays."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


@afresh
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document with a smaller doc_id has are cut out."""
    return substrings.without_repeats(docs, size=13)


@afresh
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that align with a benchmark item go."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


@afresh
def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, score, nbest_scores, ids and round_trip of every document left."""
    return pieces.encode(docs, PIECE_MODEL, n=3)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]

#: Classifiers, fingerprints and lattices have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else saved(out, name)
    return docs
