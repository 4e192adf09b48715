"""Questions to filter plans: rule tables over named competitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first pattern that matches names a competition outright.
DOMESTIC = (
    (r"(?i)\branji(\s+trophy)?\b|\bdomestic\s+multi-?day\b", "bcci_domestic_multiday"),
    (r"(?i)\bvijay\s+hazare(\s+trophy)?\b|\bdomestic\s+odi\b|\bdomestic\s+one-?day\b", "bcci_domestic_odi"),
    (r"(?i)\bsyed\s+mushtaq\s+ali(\s+trophy)?\b|\bdomestic\s+t20\b", "bcci_domestic_t20"),
)
#: Formats, of which exactly one must match to be a filter, two or more are a comparison.
FORMATS = (
    (r"(?i)\b(ipl|indian premier league)\b", "ipl"),
    (r"(?i)\b(t20i|t20 international)\b", "icc_t20i"),
    (r"(?i)\b(icc\s+)?test\s+match(es)?\b", "icc_test"),
    (r"(?i)\bodi\b|\bone[- ]day international\b", "icc_odi"),
)
LOOSE_TEST = (r"(?i)\btests?\b", "icc_test")
BASE = "laws"
COMPETITIONS = (BASE, "ipl", "icc_t20i", "icc_test", "icc_odi", "bcci_domestic_multiday", "bcci_domestic_odi", "bcci_domestic_t20")


def domestic(question: Column) -> Column:
    return F.coalesce(*[F.when(question.rlike(p), F.lit(c)) for p, c in DOMESTIC])


def formats(question: Column) -> Column:
    """Sorted competitions whose format is named; a bare Test counts beside another."""
    named = F.array_compact(F.array(*[F.when(question.rlike(p), F.lit(c)) for p, c in FORMATS]))
    loose = F.when((F.size(named) > 0) & question.rlike(LOOSE_TEST[0]), F.array_union(named, F.array(F.lit(LOOSE_TEST[1])))).otherwise(named)
    return F.array_sort(loose)


def allowed(competition: Column) -> Column:
    """The competition and the base laws; null for null and for unknown ones."""
    return F.when(competition == BASE, F.array(F.lit(BASE))).when(competition.isin(*COMPETITIONS), F.array(competition, F.lit(BASE)))


def plan(questions: DataFrame) -> DataFrame:
    """``questions(qid, question, override)`` with competition, allowed and compared. An override disables comparison."""
    q = F.coalesce("question", F.lit(""))
    base = questions.select("*", domestic(q).alias("__d"), formats(q).alias("__f"))
    found = F.coalesce(F.col("override"), F.col("__d"), F.when(F.size("__f") == 1, F.col("__f")[0]))
    compared = F.when(F.col("override").isNull() & F.col("__d").isNull() & (F.size("__f") >= 2), F.col("__f"))
    return base.withColumn("competition", found).withColumn("allowed", allowed(F.col("competition"))).withColumn("compared", compared).drop("__d", "__f")


def plan_with_provider(questions: DataFrame, provider: Callable[[list[str]], list[list[str] | None]]) -> DataFrame:
    """As ``plan``, but a provider names the competitions of questions without override; its failures fall back to the rules.

    Two or more names compare, one filters, an empty list does neither.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                named = provider(pdf["question"].fillna("").tolist())
            except Exception:  # any failure of the provider means the rules decide
                named = [None] * len(pdf)
            yield pd.DataFrame({"qid": pdf["qid"], "named": named})

    given = questions.select("qid", "question").mapInPandas(ask, "qid string, named array<string>")
    ruled = plan(questions).join(given, "qid", "left")
    own = F.col("override").isNull() & F.col("named").isNotNull()
    one = F.when(F.size("named") == 1, F.col("named")[0])
    return ruled.withColumn("competition", F.when(own, one).otherwise(F.col("competition"))).withColumn("allowed", allowed(F.col("competition"))).withColumn("compared", F.when(own, F.when(F.size("named") >= 2, F.array_sort("named"))).otherwise(F.col("compared"))).drop("named")
