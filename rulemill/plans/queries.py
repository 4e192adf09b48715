"""Registered queries of the core: operators bound to the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill.functions.texts import passage
from rulemill.operators import answering, chunking, discovery, evaluation, indexing, pipeline, planner, retrieval, segment, textprep, training
from rulemill.operators.neardup import p6_found, p6_groups
from rulemill.operators.overlap import p3_found, p3_report
from rulemill.operators.splits import p4_found, p4_invariants, p4_shares, p4_splits
from rulemill.operators.splitting import p5_found, p5_pieces, p5_rejoined
from rulemill.plans import sql
from rulemill.schemas import CHUNK_COLUMNS
from rulemill.session import table
from rulemill.sources.io import last_of_each

#: Snapshot time that stands for an index made before late deliveries.
CUT = "2026-04-01 00:00:00"
INDEX_VERSION = "v1"
COMPARED = ("icc_odi", "icc_t20i", "icc_test")


# -- tables as the operators take them


def chunks(s: SparkSession, d: str) -> DataFrame:
    """One row per chunk: rows delivered twice differ only in ingested_at."""
    return table(s, d, "chunks").select(*CHUNK_COLUMNS).distinct()


def pages(s: SparkSession, d: str) -> DataFrame:
    """Passages stand for pages: a document's chunks in the order of page, clause and index."""
    c = chunks(s, d)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_start", "chunk_id"))
    return c.select("doc_id", n.alias("page"), passage(F.col("text")).alias("text"))


def registry(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sources").withColumn("ord", F.monotonically_increasing_id())


def golden(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "golden_items").select(F.col("id").alias("qid"), "question", F.when(F.col("competition") != "any", F.col("competition")).alias("override"), "type", "gold")


def asked(s: SparkSession, d: str) -> DataFrame:
    return planner.plan(golden(s, d))


# -- retrieval


def _version(s: SparkSession, d: str) -> str:
    """The version of the index: that of the table as delivered."""
    return retrieval.fingerprint(table(s, d, "chunks"))


def _bm25(s: SparkSession, d: str, filtered: bool) -> DataFrame:
    q = asked(s, d)
    q = q.select("qid", "question", "allowed" if filtered else F.lit(None).cast("array<string>").alias("allowed"))
    return retrieval.bm25(chunks(s, d).select("chunk_id", "competition", "status", "text"), q, version=_version(s, d))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d, False)


def bm25_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d, True)


def corpus_term_stats(s: SparkSession, d: str) -> DataFrame:
    return retrieval.term_statistics(chunks(s, d).select("text")).select("token", "df", F.round("idf", 6).alias("idf"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("grp"))


def _vector_queries(s: SparkSession, d: str, grouped: bool) -> DataFrame:
    v = _vectors(s, d).where("key % 50 = 0")
    return v.select(F.col("key").alias("query"), "vector", F.col("grp") if grouped else F.lit(None).cast("int").alias("grp"))


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_topk(_vectors(s, d), _vector_queries(s, d, False))


def dense_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_topk(_vectors(s, d), _vector_queries(s, d, True))


def hashed_embedding(s: SparkSession, d: str) -> DataFrame:
    f = retrieval.hashed_features(chunks(s, d).select(F.col("chunk_id").alias("key"), "text"))
    return f.select(F.col("key").alias("chunk_id"), "dim", F.round("value", 6).alias("value"))


def _hashed_topk(s: SparkSession, d: str) -> DataFrame:
    docs = retrieval.hashed_vectors(chunks(s, d).where("status = 'active'").select(F.col("chunk_id").alias("key"), "text"))
    qs = retrieval.hashed_vectors(golden(s, d).select(F.col("qid").alias("key"), F.col("question").alias("text")))
    none = F.lit(None).cast("string").alias("grp")
    top = retrieval.dense_topk(docs.select("key", "vector", none), qs.select(F.col("key").alias("query"), "vector", none))
    return top.select(F.col("query").alias("qid"), "rank", F.col("key").alias("chunk_id"), "score")


def hashed_dense_topk(s: SparkSession, d: str) -> DataFrame:
    return _hashed_topk(s, d)


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion([_hashed_topk(s, d), bm25_topk(s, d)])


def _candidates(s: SparkSession, d: str) -> DataFrame:
    about = chunks(s, d).select("chunk_id", "competition", "gender", "clause_title", "doc_id", "clause", "page_start", "page_end", "text")
    rows = bm25_topk(s, d).drop("score").join(about, "chunk_id").join(golden(s, d).select("qid", "question"), "qid")
    return rows.withColumn("logit", retrieval.overlap_logit(F.col("question"), F.col("text")))


def rerank_blend(s: SparkSession, d: str) -> DataFrame:
    r = retrieval.rerank(_candidates(s, d).select("qid", "rank", "chunk_id", "logit"))
    return r.select("qid", "rank", "chunk_id", "score", F.round("raw_score", 6).alias("raw_score"))


def _compared(s: SparkSession, d: str) -> DataFrame:
    """Questions on formats compare three competitions."""
    q = golden(s, d).where("type like 'format%'")
    return q.select("qid", F.posexplode(F.array(*[F.lit(c) for c in COMPARED])).alias("position", "competition"))


def comparison_topup(s: SparkSession, d: str) -> DataFrame:
    found = _candidates(s, d).where(F.col("rank") <= retrieval.CONTEXT_K).select("qid", "rank", "chunk_id", "competition")
    compared = _compared(s, d)
    q = golden(s, d).join(compared, "qid").select(F.concat_ws("|", "qid", "competition").alias("qid"), "question", F.array("competition").alias("allowed"))
    pool = retrieval.bm25(chunks(s, d).select("chunk_id", "competition", "status", "text"), q, retrieval.TOPUP_K, _version(s, d))
    parts = F.split("qid", r"\|")
    pools = pool.select(parts[0].alias("qid"), parts[1].alias("competition"), F.col("rank").alias("pool_rank"), "chunk_id")
    return retrieval.top_up(found, compared, pools)


def diverse_context(s: SparkSession, d: str) -> DataFrame:
    ranked = _candidates(s, d).select("qid", "rank", "chunk_id", "competition", "gender", "clause_title", retrieval.wants_women(F.col("question")).alias("women"))
    return retrieval.select_context(ranked, _compared(s, d))


# -- answers and evaluation


def _context(s: SparkSession, d: str) -> DataFrame:
    return bm25_topk(s, d).where(F.col("rank") <= retrieval.CONTEXT_K)


def context_format(s: SparkSession, d: str) -> DataFrame:
    body = chunks(s, d).select("chunk_id", "doc_id", "clause", "page_start", "text")
    out = answering.format_context(_context(s, d).select("qid", "rank", "chunk_id"), body, last_of_each(registry(s, d)))
    return out.select("qid", F.md5("context").alias("context_md5"), F.length("context").cast("bigint").alias("n_chars"))


def _gold(s: SparkSession, d: str) -> DataFrame:
    return golden(s, d).select("qid", F.posexplode("gold").alias("n", "g")).select("qid", "n", "g.doc_id", "g.clause")


def citation_matches(s: SparkSession, d: str) -> DataFrame:
    cites = _gold(s, d).withColumn("page", F.regexp_extract("clause", r"^(\d+)", 1).cast("int"))
    about = chunks(s, d).select("chunk_id", "doc_id", "clause", "page_start", "page_end")
    top = bm25_topk(s, d).select("qid", "rank", "chunk_id").join(about, "chunk_id")
    return answering.match_citations(cites, top).select("qid", "n", "doc_id", "clause", "page", "chunk_id", "valid")


def citation_validation(s: SparkSession, d: str) -> DataFrame:
    answers = golden(s, d).select("qid", (F.col("type") != "unanswerable").alias("found"))
    return answering.validate(answers, citation_matches(s, d))


def answer_metrics(s: SparkSession, d: str) -> DataFrame:
    hit = eval_hit_rank(s, d).select("qid", F.col("rank").isNotNull().alias("any_gold_cited"), "type")
    m = evaluation.answer_metrics(citation_validation(s, d).join(hit, "qid"))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


def answer_cache_key(s: SparkSession, d: str) -> DataFrame:
    return answering.cache_keys(golden(s, d), _context(s, d), INDEX_VERSION)


def extractive_answers(s: SparkSession, d: str) -> DataFrame:
    body = chunks(s, d).select("chunk_id", "doc_id", "clause", "page_start", "text")
    ctx = answering.format_context(_context(s, d).select("qid", "rank", "chunk_id"), body, last_of_each(registry(s, d)))
    return answering.answer(golden(s, d).select("qid", "question").join(ctx, "qid", "left"))


def eval_hit_rank(s: SparkSession, d: str) -> DataFrame:
    about = chunks(s, d).select("chunk_id", "doc_id", "clause")
    ranks = evaluation.hit_ranks(bm25_topk(s, d).join(about, "chunk_id"), _gold(s, d), golden(s, d))
    return ranks.join(golden(s, d).select("qid", "type"), "qid").select("qid", "rank", "type")


def eval_metrics_by_type(s: SparkSession, d: str) -> DataFrame:
    return evaluation.retrieval_metrics(eval_hit_rank(s, d), "type")


def eval_failures(s: SparkSession, d: str) -> DataFrame:
    return evaluation.failures(eval_hit_rank(s, d))


def ask_pipeline(s: SparkSession, d: str) -> DataFrame:
    return pipeline.ask(golden(s, d).select("qid", "question", "override"), chunks(s, d), last_of_each(registry(s, d)))


def eval_configs(s: SparkSession, d: str) -> DataFrame:
    return pipeline.evaluate(golden(s, d), chunks(s, d))


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return evaluation.latency_statistics(table(s, d, "events"), "value", "event_type")


# -- text preparation and chunks


def repeated_lines(s: SparkSession, d: str) -> DataFrame:
    return textprep.repeated_lines(pages(s, d), 0.02)


def cleaned_pages(s: SparkSession, d: str) -> DataFrame:
    return textprep.clean_pages(pages(s, d), 0.02)


def normalized_lines(s: SparkSession, d: str) -> DataFrame:
    return textprep.normalized_lines(pages(s, d))


def heading_lines(s: SparkSession, d: str) -> DataFrame:
    lines = textprep.normalized_lines(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), "text"))
    return lines.select("doc_id", "line_no", "line", textprep.heading_kind(F.col("line")).alias("kind")).where("kind <> 'body'")


def monotone_headings(s: SparkSession, d: str) -> DataFrame:
    """Law numbers of the rulebooks in page order, kept where they rise."""
    c = chunks(s, d).select("doc_id", "page_start", "chunk_id", "law_no")
    return textprep.increasing(c, "doc_id", ["page_start", "chunk_id"], "law_no").select("doc_id", "chunk_id", "law_no")


def dedupe_longest(s: SparkSession, d: str) -> DataFrame:
    c = chunks(s, d).select("doc_id", "clause", F.col("chunk_id").alias("ord"), "text")
    return textprep.longest_per_clause(c).select("doc_id", "clause", F.col("ord").alias("chunk_id"), F.length("text").cast("bigint").alias("n_chars"))


def segment_clauses(s: SparkSession, d: str) -> DataFrame:
    """Rulebooks rebuilt as pages of headed text, and segmented again."""
    c = chunks(s, d)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_start", "chunk_id"))
    text = F.concat(F.concat_ws("\n", F.concat_ws(" ", F.lit("LAW"), "law_no", F.upper("clause_title")), F.concat_ws(" ", "clause", "clause_title")), F.lit("\n"), passage(F.col("text")))
    return segment.segment_documents(c.select("doc_id", n.alias("page"), text.alias("text")))


def chunk_build(s: SparkSession, d: str) -> DataFrame:
    """Chunks built from the passages as clause records."""
    c = chunks(s, d)
    records = c.select("doc_id", "law_no", F.concat_ws("-", "clause", F.col("chunk_index").cast("string")).alias("clause"), "clause_title", "section_path", "page_start", "page_end", passage(F.col("text")).alias("text"))
    return chunking.build_chunks(records, last_of_each(registry(s, d)))


def chunk_headers(s: SparkSession, d: str) -> DataFrame:
    """Header and hash made anew from the registry and the fields."""
    src = last_of_each(registry(s, d)).select("doc_id", "title")
    c = chunks(s, d).join(src, "doc_id")
    return c.select("chunk_id", chunking.header(F.col("title"), F.col("clause"), F.col("clause_title")).alias("header"), F.sha2("text", 256).alias("hash"))


def chunk_stats(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_statistics(chunks(s, d))


def chunk_batches(s: SparkSession, d: str) -> DataFrame:
    return chunking.batches(chunks(s, d))


def chunk_metadata(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).drop("text")


# -- index, registry, manifest


def _old_index(s: SparkSession, d: str) -> DataFrame:
    """What had been delivered at the cut; chunks of law 1 still had the other status then, those of law 2 another text."""
    old = table(s, d, "chunks").where(F.col("ingested_at") < F.lit(CUT).cast("timestamp")).select(*CHUNK_COLUMNS).distinct()
    status = F.when(F.col("law_no") == 1, F.when(F.col("status") == "active", "superseded").otherwise("active")).otherwise(F.col("status"))
    return old.withColumn("status", status).withColumn("content_hash", F.when(F.col("law_no") == 2, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("content_hash")))


def index_sync_actions(s: SparkSession, d: str) -> DataFrame:
    incoming = chunks(s, d).where("law_no <> 3")
    return indexing.sync_actions(incoming, _old_index(s, d))


def index_version(s: SparkSession, d: str) -> DataFrame:
    return indexing.index_version(chunks(s, d))


def supersede(s: SparkSession, d: str) -> DataFrame:
    rows = indexing.apply_supersede(last_of_each(registry(s, d)))
    return rows.select("doc_id", "effective_from", "status")


def status_changes(s: SparkSession, d: str) -> DataFrame:
    """Documents whose status in the registry is not the one that supersession gives."""
    before = last_of_each(registry(s, d))
    after = indexing.apply_supersede(before).select("doc_id", F.col("status").alias("new_status"))
    return before.select("doc_id", "status").join(after, "doc_id").where("not status <=> new_status")


def merge_sources(s: SparkSession, d: str) -> DataFrame:
    found = table(s, d, "manifest").where("doc_id is not null").select("doc_id", F.concat(F.lit("Found "), "doc_id").alias("title"), F.concat("url", F.lit("?v="), F.substring("sha256", 1, 4)).alias("url"), F.concat("downloaded_at", "sha256").alias("ord"))
    return indexing.merge_sources(last_of_each(registry(s, d)), found)


def manifest_changes(s: SparkSession, d: str) -> DataFrame:
    return indexing.manifest_changes(table(s, d, "manifest"))


def affected_documents(s: SparkSession, d: str) -> DataFrame:
    changed = manifest_changes(s, d).where("changed and doc_id is not null").select("doc_id")
    return changed.union(status_changes(s, d).select("doc_id")).distinct()


def reingest_exclude(s: SparkSession, d: str) -> DataFrame:
    again = last_of_each(registry(s, d)).where("manual").select("doc_id")
    return training.remaining(chunks(s, d).select("chunk_id", "doc_id"), again, "doc_id")


def resume_remaining(s: SparkSession, d: str) -> DataFrame:
    """Questions without mined negatives yet."""
    return training.remaining(table(s, d, "synthetic_questions").where("qid is not null").select("qid").distinct(), table(s, d, "mined_negatives"), "qid")


# -- planning and discovery


def query_plan_rules(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "synthetic_questions").where("qid is not null and question is not null").select("qid", "question", F.lit(None).cast("string").alias("override")).distinct()
    p = planner.plan(q)
    return p.select("qid", "competition", F.array_join("allowed", ",").alias("allowed"), F.array_join("compared", ",").alias("compared"))


def title_metadata(s: SparkSession, d: str) -> DataFrame:
    src = last_of_each(registry(s, d))
    t, u = F.col("title"), F.coalesce("url", F.lit(""))
    return src.select("doc_id", discovery.gender(t).alias("title_gender"), discovery.format_of(t).alias("title_format"), discovery.effective_date(t).alias("title_date"), discovery.url_date(u).alias("url_date"), discovery.doc_id(F.col("body"), F.coalesce("gender", F.lit("all")), F.col("competition"), F.col("effective_from")).alias("made_id"))


def keyword_filter(s: SparkSession, d: str) -> DataFrame:
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return last_of_each(registry(s, d)).where(discovery.passes_keywords(F.col("title"), words("playing", "LAWS"), words("union"))).select("doc_id", "title")


# -- training sets


def leakage_guard(s: SparkSession, d: str) -> DataFrame:
    return retrieval.near_any(_vectors(s, d), _vector_queries(s, d, False), 0.4)


def hard_negatives(s: SparkSession, d: str) -> DataFrame:
    top = retrieval.dense_topk(_vectors(s, d), _vector_queries(s, d, False), 30)
    labels = _vectors(s, d).select(F.col("key").alias("k"), F.col("grp").alias("l"))
    own = labels.select(F.col("k").alias("query"), F.col("l").alias("own"))
    rows = top.join(labels, top["key"] == labels["k"]).join(own, "query")
    rows = rows.select("query", "rank", "key", (F.col("query") == F.col("key")).alias("positive"), (F.col("own") % 2 == 0).alias("named"), F.when(F.col("l") == F.col("own"), F.lit(1.0)).otherwise(F.col("score")).alias("similarity"))
    return training.hard_negatives(rows)


def mined_passages(s: SparkSession, d: str) -> DataFrame:
    """Hard negatives of the golden questions among all passages."""
    return pipeline.mine_negatives(asked(s, d), _gold(s, d), chunks(s, d), version=_version(s, d))


def stratified_subset(s: SparkSession, d: str) -> DataFrame:
    return training.stratified_subset(chunks(s, d).select("chunk_id", "doc_id"))


def competition_labels(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).groupBy("competition", "gender").agg(F.count("*").alias("n")).select("competition", "gender", training.competition_label(F.col("competition"), F.col("gender")).alias("label"), "n")


def group_split(s: SparkSession, d: str) -> DataFrame:
    return training.group_split(table(s, d, "synthetic_questions").select(F.col("pos_chunk_id").alias("grp")))


def training_rows(s: SparkSession, d: str) -> DataFrame:
    return training.training_rows(table(s, d, "synthetic_questions"), table(s, d, "mined_negatives"), table(s, d, "chunks")).select("qid", "query", "chunk_id", F.col("label").cast("bigint").alias("label"))


def evaluator_groups(s: SparkSession, d: str) -> DataFrame:
    return training.evaluator_groups(training_rows(s, d))


def dataset_info(s: SparkSession, d: str) -> DataFrame:
    pos = table(s, d, "synthetic_questions").select("qid", F.col("pos_chunk_id").alias("grp")).distinct()
    rows = training_rows(s, d).join(pos, "qid").join(group_split(s, d), "grp")
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("qid").alias("n_questions"), F.sum("label").alias("n_positive"))


NAMES = (
    bm25_topk, bm25_topk_filtered, corpus_term_stats, dense_topk, dense_topk_filtered, hashed_embedding, hashed_dense_topk, rrf_fusion, rerank_blend, comparison_topup, diverse_context,
    context_format, citation_matches, citation_validation, answer_metrics, answer_cache_key, extractive_answers, eval_hit_rank, eval_metrics_by_type, eval_failures, eval_configs, ask_pipeline, latency_percentiles,
    repeated_lines, cleaned_pages, normalized_lines, heading_lines, monotone_headings, dedupe_longest, segment_clauses, chunk_build, chunk_headers, chunk_stats, chunk_batches, chunk_metadata,
    index_sync_actions, index_version, supersede, status_changes, merge_sources, manifest_changes, affected_documents, reingest_exclude, resume_remaining,
    query_plan_rules, title_metadata, keyword_filter, leakage_guard, hard_negatives, mined_passages, stratified_subset, competition_labels, group_split, training_rows, evaluator_groups, dataset_info,
    p3_found, p3_report, p4_found, p4_splits, p4_shares, p4_invariants, p5_found, p5_pieces, p5_rejoined, p6_found, p6_groups,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    return sql.QUERIES
