"""Retrieval and answer metrics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECALL_KS, MRR_K = (1, 5, 20), 10
DIGITS = 9


def hit_ranks(ranked: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, rank`` of the first retrieved (doc_id, clause) in gold, null where none is; every question has a row."""
    hits = ranked.join(gold.select("qid", "doc_id", "clause").distinct(), ["qid", "doc_id", "clause"], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    return questions.select("qid").distinct().join(hits, "qid", "left")


def retrieval_metrics(ranks: DataFrame, by: str) -> DataFrame:
    """Hit rates and MRR overall (``by`` null) and for each value of ``by``; questions whose ``by`` is unanswerable are left out."""
    hit = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), DIGITS).alias(f"recall_at_{k}") for k in RECALL_KS]
    rr = F.round(F.avg(F.when(F.col("rank") <= MRR_K, 1.0 / F.col("rank")).otherwise(0.0)), DIGITS).alias("mrr_at_10")
    rows = ranks.where(F.col(by) != "unanswerable")
    return rows.groupingSets([[], [F.col(by)]], by).agg(F.count("*").alias("n"), *hit, rr)


def latency_statistics(values: DataFrame, value: str, by: str) -> DataFrame:
    """Exact median, 95th percentile (linear between ranks) and mean by group; nulls do not count."""
    p = lambda q: F.round(F.percentile(F.col(value), F.lit(q)), 6)
    return values.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg(value), 6).alias("mean"))


def answer_metrics(rows: DataFrame) -> DataFrame:
    """One row from ``rows(type, found, citation_valid, any_gold_cited)``: rates, null where nothing counts."""
    share = lambda cond, over: F.avg(F.when(over, F.when(cond, 1.0).otherwise(0.0)))
    un = F.col("type") == "unanswerable"
    return rows.agg(share(F.col("any_gold_cited"), ~un).alias("citation_accuracy"), share(F.col("citation_valid"), F.col("found")).alias("citation_validity_rate"), share(~F.col("found"), un).alias("not_found_rate_unanswerable"))


def failures(ranks: DataFrame, limit_rank: int = 5) -> DataFrame:
    """Answerable questions without a hit up to ``limit_rank``."""
    return ranks.where((F.col("type") != "unanswerable") & (F.col("rank").isNull() | (F.col("rank") > limit_rank)))
