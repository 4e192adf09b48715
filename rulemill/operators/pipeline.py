"""The whole path from questions to validated answers, for many questions at once, and its configurations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.operators import answering, chunking, evaluation, planner, retrieval, segment, training

STAGES = ("dense", "bm25", "hybrid")


@dataclass(frozen=True)
class Config:
    """A retrieval configuration; ``reranker`` names a function from question and text columns to a logit."""

    name: str
    first_stage: str
    reranker: str | None = None


RERANKERS: dict[str, Callable] = {"overlap": retrieval.overlap_logit}
CONFIGS = (Config("dense", "dense"), Config("dense+rerank", "dense", "overlap"), Config("bm25", "bm25"), Config("hybrid", "hybrid"), Config("hybrid+rerank", "hybrid", "overlap"))


def available(configs=CONFIGS) -> tuple[list[Config], list[str]]:
    """The configurations whose reranker is registered, and a message for each of the others."""
    ok = [c for c in configs if c.reranker is None or c.reranker in RERANKERS]
    return ok, [f"{c.name}: no reranker {c.reranker!r}" for c in configs if c not in ok]


def retrieve(chunks: DataFrame, questions: DataFrame, first_stage: str = "dense", k: int = retrieval.RETRIEVE_K, version: str | None = None) -> DataFrame:
    """``qid, rank, chunk_id, score`` by dense, bm25 or both fused; an unknown stage is an error.

    Dense search uses hashed token vectors; a model's vectors can take their place in ``dense_topk``.
    Questions without tokens have no dense rows.
    """
    if first_stage not in STAGES:
        raise ValueError(f"unknown first stage {first_stage!r}; known are {STAGES}")
    text = chunks.select("chunk_id", "competition", "status", "text")
    if first_stage == "bm25":
        return retrieval.bm25(text, questions, k, version)
    docs = retrieval.hashed_vectors(text.where("status = 'active'").select(F.col("chunk_id").alias("key"), "text"))
    docs = docs.join(text.select(F.col("chunk_id").alias("key"), F.col("competition").alias("grp")), "key")
    asked = retrieval.hashed_vectors(questions.select(F.col("qid").alias("key"), F.col("question").alias("text")))
    asked = asked.join(questions.select(F.col("qid").alias("key"), F.when(F.size("allowed") > 0, F.col("allowed")).alias("grp")), "key")
    top = retrieval.dense_topk(docs, asked.select(F.col("key").alias("query"), "vector", "grp"), k)
    dense = top.select(F.col("query").alias("qid"), "rank", F.col("key").alias("chunk_id"), "score")
    if first_stage == "dense":
        return dense
    return retrieval.reciprocal_rank_fusion([dense, retrieval.bm25(text, questions, k, version)], k)


def ranked(chunks: DataFrame, plans: DataFrame, first_stage: str = "dense", reranker: str | None = "overlap", k: int = retrieval.RETRIEVE_K) -> DataFrame:
    """Retrieved rows with what is compared but missing added, reranked: ``qid, rank, chunk_id, score, raw_score``."""
    if reranker is not None and reranker not in RERANKERS:
        raise ValueError(f"unknown reranker {reranker!r}; known are {sorted(RERANKERS)}")
    about = chunks.select("chunk_id", "competition")
    found = retrieve(chunks, plans, first_stage, k).drop("score").join(about, "chunk_id")
    compared = plans.where("compared is not null").select("qid", "question", F.explode("compared").alias("competition"))
    alone = compared.select(F.concat_ws("\u0001", "qid", "competition").alias("qid"), "question", F.array("competition").alias("allowed"))
    parts = F.split("qid", "\u0001")
    pools = retrieve(chunks, alone, first_stage, retrieval.TOPUP_K).select(parts[0].alias("qid"), parts[1].alias("competition"), F.col("rank").alias("pool_rank"), "chunk_id")
    rows = retrieval.top_up(found, compared, pools)
    if reranker is None:
        return rows.select("qid", "rank", "chunk_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("raw_score"))
    scored = rows.join(chunks.select("chunk_id", "text"), "chunk_id").join(plans.select("qid", "question"), "qid").withColumn("logit", RERANKERS[reranker](F.col("question"), F.col("text")))
    return retrieval.rerank(scored.select("qid", "rank", "chunk_id", "logit"))


def mine_negatives(plans: DataFrame, gold: DataFrame, chunks: DataFrame, first_stage: str = "bm25", version: str | None = None) -> DataFrame:
    """``qid, chunk_id, n``: hard negatives of planned questions among the passages retrieved for them.

    ``gold(qid, doc_id, clause)`` names the positives. Where the plan names no competition, passages as
    near to a positive as a false negative would be are dropped; nearness is that of hashed vectors.
    Questions without positives keep all their candidates; those without candidates have no rows.
    """
    top = retrieve(chunks, plans, first_stage, version=version).select("qid", "rank", "chunk_id")
    positives = training.positive_chunks(gold, chunks).join(plans.select("qid"), "qid", "left_semi")
    needed = top.select("chunk_id").union(positives.select("chunk_id")).distinct()
    vectors = retrieval.hashed_vectors(chunks.select("chunk_id", "text").join(needed, "chunk_id", "left_semi").select(F.col("chunk_id").alias("key"), "text"))
    a, b = vectors.select(F.col("key").alias("chunk_id"), F.col("vector").alias("a")), vectors.select(F.col("key").alias("p"), F.col("vector").alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = top.join(positives.withColumnRenamed("chunk_id", "p"), "qid").join(a, "chunk_id").join(b, "p").groupBy("qid", "chunk_id").agg(F.round(F.max(dot), 6).alias("similarity"))
    rows = top.join(near, ["qid", "chunk_id"], "left").join(positives.withColumn("positive", F.lit(True)), ["qid", "chunk_id"], "left")
    rows = rows.join(plans.select("qid", F.col("competition").isNotNull().alias("named")), "qid")
    ranked_rows = rows.select(F.col("qid").alias("query"), "rank", F.col("chunk_id").alias("key"), F.coalesce("positive", F.lit(False)).alias("positive"), "named", "similarity")
    return training.hard_negatives(ranked_rows).select(F.col("query").alias("qid"), F.col("key").alias("chunk_id"), "n")


def ask(questions: DataFrame, chunks: DataFrame, sources: DataFrame, provider=answering.extractive, first_stage: str = "dense", cache: str | None = None, version: str = "unversioned") -> DataFrame:
    """``qid, competition, answer, found, n_citations, n_invalid, citation_valid, context_ids`` of ``questions(qid, question, override)``.

    Null and repeated questions are answered like others; overlong ones are not found, with a valid citation state.
    With a ``cache`` folder, answers of the same question, context and index version are read from it, and new ones put there.
    """
    plans = planner.plan(questions)
    rows = ranked(chunks, plans, first_stage)
    about = chunks.select("chunk_id", "competition", "gender", "clause_title", "doc_id", "clause", "page_start", "page_end", "text")
    wide = rows.select("qid", "rank", "chunk_id").join(about, "chunk_id").join(plans.select("qid", retrieval.wants_women(F.coalesce("question", F.lit(""))).alias("women")), "qid")
    compared = plans.where("compared is not null").select("qid", F.posexplode("compared").alias("position", "competition"))
    context = retrieval.select_context(wide.select("qid", "rank", "chunk_id", "competition", "gender", "clause_title", "women"), compared)
    text = answering.format_context(context, about.select("chunk_id", "doc_id", "clause", "page_start", "text"), sources)
    prompts = questions.select("qid", "question").join(text, "qid", "left")
    answers = answering.answer_cached(prompts, answering.cache_keys(questions, context, version), cache, provider) if cache else answering.answer(prompts, provider)
    cites = answers.select("qid", F.posexplode("citations").alias("n", "c")).select("qid", "n", "c.doc_id", "c.clause", "c.page")
    checked = answering.validate(answers, answering.match_citations(cites, context.join(about.select("chunk_id", "doc_id", "clause", "page_start", "page_end"), "chunk_id")))
    ids = context.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("context_ids"))  # k at most
    return plans.select("qid", "competition").join(answers.select("qid", "answer"), "qid").join(checked, "qid").join(ids, "qid", "left")


def evaluate(golden: DataFrame, chunks: DataFrame, configs=CONFIGS) -> DataFrame:
    """Metrics of every available configuration, overall and by type: ``config, type, n, recall_at_*, mrr_at_10``.

    ``golden`` has qid, question, override, type and gold (array of doc_id and clause).
    """
    plans = planner.plan(golden)
    gold = golden.select("qid", F.explode("gold").alias("g")).select("qid", "g.doc_id", "g.clause")
    about = chunks.select("chunk_id", "doc_id", "clause")
    out = None
    for c in available(configs)[0]:
        rows = retrieve(chunks, plans, c.first_stage)
        if c.reranker:
            wide = rows.join(chunks.select("chunk_id", "text"), "chunk_id").join(plans.select("qid", "question"), "qid")
            rows = retrieval.rerank(wide.select("qid", "rank", "chunk_id", RERANKERS[c.reranker](F.col("question"), F.col("text")).alias("logit")))
        ranks = evaluation.hit_ranks(rows.join(about, "chunk_id"), gold, golden).join(golden.select("qid", "type"), "qid")
        part = evaluation.retrieval_metrics(ranks, "type").withColumn("config", F.lit(c.name))
        out = part if out is None else out.unionByName(part)
    return out


def ingest(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of whole documents: ``pages(doc_id, page, text)`` segmented into clauses and built into chunks of the registry's documents."""
    return chunking.build_chunks(segment.segment_documents(pages), sources)
