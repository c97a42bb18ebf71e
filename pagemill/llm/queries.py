"""The registered queries of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, langid, langmodel, licenses, pieces, quality, simhash, substrings, toxicity, urls
from pagemill.llm.store import load


#: The SentencePiece model that op1_sentencepiece reads on the driver.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(load(spark, sf_dir, "documents"), PIECE_MODEL, n=3, segmentations=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), divisor=3, rest=1)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=3, max_distance=2)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.corpus_scores(load(spark, sf_dir, "documents"), divisor=7, rest=2)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(load(spark, sf_dir, "documents"), size=13)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"), divisor=4, rest=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = urls.page_outcomes(load(spark, sf_dir, "labels"))
    return urls.judge(load(spark, sf_dir, "pages"), outcomes).withColumn("bad_bound", F.round("bad_bound", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {"op10_url_filter": urls.ORACLE}
