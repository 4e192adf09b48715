"""Queries of the training-text problems, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulemill.llm.leakage import leaks, p2_found
from rulemill.llm.mixing import mix_report, mix_sources
from rulemill.llm.pairs import p1_found
from rulemill.llm.sentences import split_sentences
from rulemill.llm.tokenizers import encode_corpus
from rulemill.session import table


def p2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "synthetic_questions"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "golden_items"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(mix_sources(table(spark, sf_dir, "documents"), targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_leaks": p2_leaks, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    return {}
