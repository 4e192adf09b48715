"""Mixing sources to target weights (problem 8).

Texts are counted once per source and exact token length. Those small histograms fix a total
budget that every source can meet, give each source its budget, split it into whole passes
over the source and a rest, and choose by a bounded-knapsack program how many texts of each
length fill the rest. Texts of a length are then taken in the order of a seeded hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulemill.functions.subset_sum import nearest_subset
from rulemill.session import cut
from rulemill.llm.tokenizers import DEFAULT_VOCABULARY, count_tokens

#: Each (source, length) is split into hashed cells of at most about so many texts, so that copies of one text share no task.
CELL_ROWS, LEAST_SALTS = 500_000, 16
SEED = 42


def clean_source(col):
    """Canonical source name: trimmed, lower case, blanks and hyphens as underscores; null and blank are ``unknown``."""
    name = F.regexp_replace(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), r"[\s\-]+", "_")
    return F.when(name.isNull() | (name == ""), F.lit("unknown")).otherwise(name)


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """One source: histogram rows to (source, n_tokens, passes, extra)."""
    budget, total = int(frame["budget"].iloc[0]), int(frame["total"].iloc[0])
    passes, rest = divmod(budget, total) if total else (0, 0)
    cap = int(frame["max_repeats"].iloc[0])
    if passes >= cap:
        passes, rest = cap, 0
    frame = frame.sort_values(["n_tokens", "salt"], ignore_index=True)
    by_length = frame.groupby("n_tokens")["n_texts"]
    sizes = by_length.sum()
    extra = nearest_subset(sizes.index.tolist(), sizes.tolist(), rest)
    before = by_length.cumsum() - frame["n_texts"]
    want = frame["n_tokens"].map(lambda n: extra.get(int(n), 0)) - before
    return pd.DataFrame({"clean_source": frame["clean_source"], "n_tokens": frame["n_tokens"], "salt": frame["salt"], "passes": passes, "extra": want.clip(lower=0, upper=frame["n_texts"])})


def plan_mix(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Budgets and fills by source and length from ``sizes(clean_source, n_tokens, n_texts)``.

    Only sources that are named in the targets and have tokens take part; their shares are scaled
    to sum to 1. The total is the largest at which no source exceeds its tokens times its cap.
    """
    per_source = sizes.groupBy("clean_source").agg(F.sum(F.col("n_tokens") * F.col("n_texts")).alias("total"))
    wanted = targets.select(clean_source(F.col("source")).alias("clean_source"), "target_share", "max_repeats").groupBy("clean_source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    both = per_source.join(F.broadcast(wanted), "clean_source").where("total > 0 and target_share > 0 and max_repeats > 0")
    whole = both.agg(F.sum("target_share").alias("all_share"), F.min(F.col("total") * F.col("max_repeats") / F.col("target_share")).alias("raw"))
    whole = whole.select("all_share", F.floor(F.col("raw") * F.col("all_share")).alias("grand_total"))
    # per_source, wanted and whole have one row per source at most
    budgets = both.crossJoin(F.broadcast(whole)).select("clean_source", "total", "max_repeats", F.least(F.floor(F.col("grand_total") * F.col("target_share") / F.col("all_share")), F.col("total") * F.col("max_repeats")).cast("bigint").alias("budget"), (F.col("target_share") / F.col("all_share")).alias("share"))
    return budgets


def mix_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, seed: int = SEED) -> DataFrame:
    """How often each text is used: ``doc_id, clean_source, n_tokens, repeats`` for every document.

    Null, empty and blank texts and sources without a target get 0; a target without texts is
    left out and the other shares are scaled up. Repeated texts are separate texts. No text is
    used more than its source's ``max_repeats``. Ties of length are ordered by a seeded hash of
    doc_id. Extra columns are ignored.
    """
    texts = documents.select("doc_id", clean_source(F.col("source")).alias("clean_source"), "text")
    counted = cut(count_tokens(texts, ["doc_id", "clean_source"], "text", vocabulary))  # texts are encoded once
    return _choose(counted, targets, seed)


def _choose(counted: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    salts = max(LEAST_SALTS, counted.count() // CELL_ROWS)
    counted = counted.withColumn("salt", F.pmod(order, F.lit(salts)).cast("int"))
    sizes = counted.where("n_tokens > 0").groupBy("clean_source", "n_tokens", "salt").agg(F.count("*").alias("n_texts"))
    budgets = plan_mix(sizes, targets)
    plan = (
        sizes.join(F.broadcast(budgets), "clean_source")
        .groupBy("clean_source")
        .applyInPandas(_plan, "clean_source string, n_tokens bigint, salt int, passes bigint, extra bigint")
    )
    place = Window.partitionBy("clean_source", "n_tokens", "salt").orderBy(order, "doc_id")
    ranked = counted.withColumn("place", F.row_number().over(place))
    used = ranked.join(plan, ["clean_source", "n_tokens", "salt"], "left")
    repeats = F.coalesce(F.col("passes") + (F.col("place") <= F.col("extra")).cast("bigint"), F.lit(0))
    return used.select("doc_id", "clean_source", "n_tokens", F.when(F.col("n_tokens") > 0, repeats).otherwise(F.lit(0)).cast("bigint").alias("repeats"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached: one row per target source, with texts, tokens, repeats and both shares."""
    wanted = targets.select(clean_source(F.col("source")).alias("clean_source"), "target_share", "max_repeats").groupBy("clean_source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    per = mixed.groupBy("clean_source").agg(
        F.sum((F.col("n_tokens") > 0).cast("bigint")).alias("n_texts"),
        F.sum("n_tokens").alias("tokens_available"),
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"),
        F.max("repeats").alias("most_repeats"),
    )
    total = per.agg(F.sum("tokens_used").alias("all_tokens"))
    rows = wanted.join(per, "clean_source", "full_outer").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        "clean_source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"),
        zero("n_texts"), zero("tokens_available"), zero("tokens_used"), zero("most_repeats"),
        F.when(F.col("all_tokens") > 0, F.coalesce("tokens_used", F.lit(0)) / F.col("all_tokens")).otherwise(F.lit(0.0)).alias("actual_share"),
    )
