"""Context text, citations, answer cache keys and answer providers."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulemill.session import cut, written
from rulemill.sources.io import cache_get, cache_put, read_log

MAX_QUESTION_CHARS, PROMPT_VERSION = 500, "v3"
NOT_FOUND = "Not found in the provided rule documents."
#: Parts of messages of failures that are tried again (fixed values).
RETRY_HINTS = ("429", "500", "502", "503", "504")
COMPETITION_VALUES = ("laws", "ipl", "icc_t20i", "icc_test", "icc_odi", "bcci_domestic_multiday", "bcci_domestic_odi", "bcci_domestic_t20", "unknown")


def format_context(context: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """``qid, context``: labelled passages in rank order, a blank line between; a missing title is the doc_id."""
    rows = context.join(chunks, "chunk_id").join(titles.select("doc_id", "title"), "doc_id", "left")
    label = F.concat(F.lit("["), F.coalesce("title", "doc_id"), F.lit(" | doc_id="), "doc_id", F.lit(" | "), "clause", F.lit(" | p."), F.col("page_start").cast("string"), F.lit("]\n"), "text")
    parts = F.array_sort(F.collect_list(F.struct("rank", label.alias("part"))))  # at most k per question
    return rows.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("context"))


def match_citations(citations: DataFrame, context: DataFrame) -> DataFrame:
    """Each of ``citations(qid, n, doc_id, clause, page)`` with the first context passage it refers to and whether it is valid.

    ``context(qid, rank, chunk_id, doc_id, clause, page_start, page_end)``. A passage matches on doc_id
    and on the clause itself or a sub-clause of it; only the first match's pages are judged.
    """
    c = context.select("qid", "rank", "chunk_id", F.col("doc_id").alias("c_doc"), F.col("clause").alias("c_clause"), "page_start", "page_end")
    on = (citations["qid"] == c["qid"]) & (citations["doc_id"] == c["c_doc"]) & ((citations["clause"] == c["c_clause"]) | citations["clause"].startswith(F.concat(c["c_clause"], F.lit("."))))
    joined = citations.join(c, on, "left").select(citations["qid"], "n", citations["doc_id"], citations["clause"], "page", "rank", "chunk_id", "page_start", "page_end")
    first = Window.partitionBy("qid", "n").orderBy(F.col("rank").asc_nulls_last())
    best = joined.withColumn("i", F.row_number().over(first)).where("i = 1")
    return best.select("qid", "n", "doc_id", "clause", "page", "chunk_id", F.coalesce(F.col("page").between(F.col("page_start"), F.col("page_end")), F.lit(False)).alias("valid"))


def validate(answers: DataFrame, matched: DataFrame) -> DataFrame:
    """``qid, found, n_citations, n_invalid, citation_valid``; an answer that is found but cites nothing is invalid."""
    counts = matched.groupBy("qid").agg(F.count("*").alias("n_citations"), F.sum((~F.col("valid")).cast("bigint")).alias("n_invalid"))
    rows = answers.select("qid", "found").join(counts, "qid", "left").select("qid", "found", F.coalesce("n_citations", F.lit(0)).cast("bigint").alias("n_citations"), F.coalesce("n_invalid", F.lit(0)).cast("bigint").alias("n_invalid"))
    return rows.withColumn("citation_valid", (F.col("n_invalid") == 0) & ~(F.col("found") & (F.col("n_citations") == 0)))


def cache_keys(questions: DataFrame, context: DataFrame, version: str, prompt_version: str = PROMPT_VERSION) -> DataFrame:
    """``qid, key``: hash of the normalised question, the context's chunk ids in order, prompt and index version."""
    ids = context.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("ids"))
    normal = F.lower(F.regexp_replace(F.regexp_replace("question", r"^\s+|\s+$", ""), r"\s+", " "))
    rows = questions.select("qid", normal.alias("q")).join(ids, "qid", "left")
    return rows.select("qid", F.sha2(F.concat_ws("|", F.coalesce("q", F.lit("")), F.coalesce("ids", F.lit("")), F.lit(prompt_version), F.lit(version)), 256).alias("key"))


def with_retries(call: Callable[[str, str], dict], backup: Callable[[str, str], dict] | None = None, outer: int = 2, waits: tuple[float, ...] = (1, 2, 4), sleep=time.sleep) -> Callable[[str, str], dict]:
    """A provider that retries transient failures with growing waits, then a backup, then answers not found."""

    def guarded(question: str, context: str) -> dict:
        for _ in range(outer):
            for i in range(len(waits) + 1):
                try:
                    return call(question, context)
                except Exception as e:  # providers raise their own kinds
                    if not any(h in str(e) for h in RETRY_HINTS):
                        break
                    if i < len(waits):
                        sleep(waits[i])
        if backup:
            try:
                return backup(question, context)
            except Exception:  # the error answer below covers it
                pass
        return {"answer": "The answer could not be generated.", "found": False, "applies_to": "unknown", "citations": [], "error": True}

    return guarded


def extractive(question: str, context: str) -> dict:
    """Deterministic provider: cites the passage that shares most words with the question."""
    asked = set(re.findall(r"[a-z0-9]+", question.lower()))
    best, score = None, 0
    for part in context.split("\n\n["):
        label, _, text = part.lstrip("[").partition("]\n")
        n = len(asked & set(re.findall(r"[a-z0-9]+", text.lower())))
        if n > score:
            best, score = (label, text), n
    if not best:
        return {"answer": NOT_FOUND, "found": False, "applies_to": "unknown", "citations": []}
    fields = best[0].split(" | ")
    cite = {"doc_id": fields[-3].removeprefix("doc_id="), "clause": fields[-2], "page": int(fields[-1].removeprefix("p."))}
    return {"answer": best[1].strip().split("\n")[-1], "found": True, "applies_to": "unknown", "citations": [cite]}


ANSWER_SCHEMA = "qid string, answer string, found boolean, applies_to string, citations array<struct<doc_id:string,clause:string,page:int>>, error boolean"


def answer(prompts: DataFrame, provider: Callable[[str, str], dict] = extractive) -> DataFrame:
    """Answers to ``prompts(qid, question, context)``. Questions above the length limit are not found without a call.

    An applies_to outside the closed list becomes unknown. Errors are marked, so that they are never cached.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                q = r.question or ""
                a = {"answer": NOT_FOUND, "found": False, "applies_to": "unknown", "citations": []} if len(q) > MAX_QUESTION_CHARS else provider(q, r.context or "")
                rows.append((r.qid, a["answer"], bool(a["found"]), a["applies_to"] if a["applies_to"] in COMPETITION_VALUES else "unknown", a["citations"], bool(a.get("error"))))
            yield pd.DataFrame(rows, columns=["qid", "answer", "found", "applies_to", "citations", "error"])

    return prompts.select("qid", "question", "context").mapInPandas(run, ANSWER_SCHEMA)


def answer_cached(prompts: DataFrame, keys: DataFrame, cache_path: str, provider: Callable[[str, str], dict] = extractive) -> DataFrame:
    """``answer`` for the prompts whose key the cache lacks, and the kept answers for the others; a column ``cached`` says which.

    ``keys(qid, key)`` are those of ``cache_keys``. New answers are put into the cache, errors are not. A
    missing cache is an empty one. Several questions of one key are asked once each and kept once.
    """
    spark = prompts.sparkSession
    held = read_log(spark, cache_path, "key string, answer_json string, written timestamp") if written(spark, cache_path) else spark.createDataFrame([], "key string, answer_json string, written timestamp")
    known = cut(cache_get(prompts.join(keys, "qid"), held))  # what is read must not be what is being written
    body = ANSWER_SCHEMA.removeprefix("qid string, ").removesuffix(", error boolean")
    hits = known.where("answer_json is not null").select("qid", F.from_json("answer_json", body).alias("a"))
    kept = hits.select("qid", "a.*", F.lit(False).alias("error"), F.lit(True).alias("cached"))
    made = cut(answer(known.where("answer_json is null").select("qid", "question", "context"), provider))
    as_json = F.to_json(F.struct("answer", "found", "applies_to", "citations"))
    cache_put(made.join(keys, "qid").select("key", as_json.alias("answer_json"), "error").dropDuplicates(["key"]), cache_path)
    return kept.unionByName(made.withColumn("cached", F.lit(False)))
