"""Lexical and dense retrieval, fusion, reranking and context selection, for many questions at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill.session import ensure_checkpoint_dir, written

RETRIEVE_K, CONTEXT_K, TOPUP_K = 20, 5, 3
MAX_VARIANTS_PER_TITLE = 2
BLEND_ALPHA = 0.85
RRF_K = 60
#: Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Questions scored lexically in one pass, and cells of the term matrix of one step.
QUESTION_BLOCK, CELLS = 1_024, 4_000_000
#: Query vectors scored against the corpus in one pass; more queries take further passes.
QUERY_BLOCK = 4_096
#: Scores are rounded before ranking, as sums of doubles differ by the order of their parts.
DIGITS = 6


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def allowed_filter(allowed: Column, competition: Column, status: Column) -> Column:
    """Active rows whose competition is allowed; a null or empty list allows all."""
    return (status == "active") & (allowed.isNull() | (F.size(allowed) == 0) | F.array_contains(allowed, competition))


def term_statistics(docs: DataFrame) -> DataFrame:
    """``token, df, idf`` of ``docs``, superseded rows included; its texts are in ``text``, or as tokens in ``toks``.

    A negative idf is replaced by EPSILON times the mean idf of the whole vocabulary. Token counts
    are combined before the shuffle; empty and null texts count as documents without tokens.
    """
    n = docs.agg(F.count("*").cast("double").alias("n"))
    lists = F.col("toks") if "toks" in docs.columns else tokens(F.col("text"))
    df = docs.select(F.explode(F.array_distinct(lists)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def fingerprint(chunks: DataFrame) -> str:
    """A version of ``chunks(chunk_id, competition, status, text)`` that any change of its rows changes, whatever their order: one scan."""
    h = F.xxhash64("chunk_id", "competition", "status", "text")
    r = chunks.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 16))).first()
    return "-".join(f"{(x or 0) & (2**64 - 1):x}" for x in r)


@dataclass(frozen=True)
class LexicalIndex:
    """Tokenised passages, term statistics and mean length of one version of the corpus, kept as tables."""

    docs: DataFrame  # chunk_id, competition, toks of active passages
    stats: DataFrame  # token, df, idf
    mean: float


def lexical_index(chunks: DataFrame, version: str | None = None) -> LexicalIndex:
    """The kept index of a version, built where there is none yet; the corpus is tokenised once per version.

    Without a version that of the rows is taken, so changed rows never meet an old index. The tables
    lie in the session's checkpoint folder; ``drop_index`` removes one.
    """
    spark = chunks.sparkSession
    version = version or fingerprint(chunks)
    path = f"{ensure_checkpoint_dir(spark)}/lexical-index/{version}"
    if not written(spark, f"{path}/stats"):
        lists = chunks.select("chunk_id", "competition", "status", tokens(F.col("text")).alias("toks"))
        lists.write.mode("overwrite").parquet(f"{path}/docs")
        lists = spark.read.parquet(f"{path}/docs")
        term_statistics(lists).write.mode("overwrite").parquet(f"{path}/stats")
    lists = spark.read.schema("chunk_id string, competition string, status string, toks array<string>").parquet(f"{path}/docs")
    mean = lists.agg(F.avg(F.coalesce(F.size("toks"), F.lit(0)))).first()[0] or 0.0
    stats = spark.read.schema("token string, df bigint, idf double").parquet(f"{path}/stats")
    return LexicalIndex(lists.where("status = 'active' and chunk_id is not null").select("chunk_id", "competition", "toks"), stats, mean)


def drop_index(spark: SparkSession, version: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/lexical-index/{version}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Bm25Block:
    """Scores Arrow batches of tokenised passages against a block of questions: term frequencies times a weight matrix.

    Every partition keeps the best k of each question, so nothing but those is shuffled.
    """

    def __init__(self, shared, k: int):
        self.shared, self.k = shared, k

    def __call__(self, batches):
        names, vocabulary, weights, allowed, mean = self.shared.value
        known = pa.array(vocabulary, pa.string())
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=object))] * len(names)
        step = max(1, CELLS // max(1, len(vocabulary)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                n = batch.num_rows
                lists = batch.column(2)
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                code = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(n), lengths)[code >= 0]
                tf = np.bincount(row * len(vocabulary) + code[code >= 0], minlength=n * len(vocabulary)).reshape(n, len(vocabulary)).astype(np.float64)
                norm = K1 * (1 - B + B * lengths / mean) if mean else np.full(n, K1)
                scores = np.round((tf * (K1 + 1) / (tf + norm[:, None])) @ weights, DIGITS)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                own = batch.column(1).to_numpy(zero_copy_only=False)
                may = {c: own == c for c in {c for x in allowed if x for c in x}}
                for j, only in enumerate(allowed):
                    ok = np.logical_or.reduce([may[c] for c in only]) if only else np.ones(n, dtype=bool)
                    least = best[j][0][-1] if len(best[j][0]) == self.k else -np.inf
                    own_scores = scores[ok, j]
                    if len(own_scores) > self.k:
                        least = max(least, np.partition(own_scores, -self.k)[-self.k])
                    ok[ok] = own_scores >= least
                    if ok.any():
                        s, x = np.concatenate([best[j][0], scores[ok, j]]), np.concatenate([best[j][1], ids[ok]])
                        order = np.lexsort((x.astype(str), -s))[: self.k]
                        best[j] = s[order], x[order]
        out = [(names[j], x, s) for j, (ss, xs) in enumerate(best) for s, x in zip(ss.tolist(), xs.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["qid", "chunk_id", "score"])


def bm25(chunks: DataFrame, questions: DataFrame, k: int = RETRIEVE_K, version: str | None = None) -> DataFrame:
    """``qid, rank, chunk_id, score``: the k best active passages of each question.

    ``chunks`` has chunk_id, competition, status, text; ``questions`` has qid, question and
    allowed (array or null). Statistics come from the unfiltered corpus, the filter from the
    question, before the cut to k. Repeated question tokens count each time. Passages of score 0
    fill up to k; ties go by chunk_id. Null questions and texts have no tokens. The questions are a
    stated query set: each block of them is broadcast and scored against all passages in one scan
    of the index that ``lexical_index`` keeps for the version.
    """
    spark = chunks.sparkSession
    index = lexical_index(chunks.select("chunk_id", "competition", "status", "text"), version)
    questions = questions.where("qid is not null").select("qid", F.coalesce(tokens(F.col("question")), F.array().cast("array<string>")).alias("toks"), "allowed")
    passes = max(1, -(-questions.count() // QUESTION_BLOCK))
    out = None
    for p in range(passes):
        part = questions if passes == 1 else questions.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p)
        rows = part.orderBy("qid").collect()  # about QUESTION_BLOCK rows
        vocabulary = sorted({t for r in rows for t in r[1]})
        needed = spark.createDataFrame([(t,) for t in vocabulary], "token string")
        idf = {r[0]: r[1] for r in index.stats.join(F.broadcast(needed), "token").select("token", "idf").collect()}  # tokens of the block
        vocabulary = [t for t in vocabulary if t in idf]
        at = {t: i for i, t in enumerate(vocabulary)}
        weights = np.zeros((len(vocabulary), len(rows)))
        for j, r in enumerate(rows):
            for t in r[1]:
                if t in at:
                    weights[at[t], j] += idf[t]
        block = [r[0] for r in rows], vocabulary, weights, [r[2] for r in rows], index.mean
        found = index.docs.mapInArrow(Bm25Block(spark.sparkContext.broadcast(block), k), "qid string, chunk_id string, score double")
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")


class BlockTopK:
    """Scores batches of vectors against a block of queries by one matrix product and keeps each query's best k."""

    def __init__(self, shared, k: int):
        self.shared, self.k = shared, k

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix, groups = self.shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            scores = np.round(np.stack(pdf["vector"].to_numpy()).astype(np.float64) @ matrix.T, DIGITS)
            keys, own = pdf["key"].to_numpy(), pdf["grp"].to_numpy()
            for j in range(len(names)):
                s, ids = scores[:, j], keys
                if groups[j] is not None:
                    ok = np.isin(own, groups[j])
                    s, ids = s[ok], ids[ok]
                if j in best:
                    s, ids = np.concatenate([best[j][0], s]), np.concatenate([best[j][1], ids])
                order = np.lexsort((ids, -s))[: self.k]
                best[j] = s[order], ids[order]
        for j, (s, ids) in best.items():
            yield pd.DataFrame({"query": names[j], "key": ids, "score": s})


class BlockMax:
    """The greatest score of each vector over a block of queries, where it reaches a threshold."""

    def __init__(self, shared, threshold: float):
        self.shared, self.threshold = shared, threshold

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix, _ = self.shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            scores = np.round(np.stack(pdf["vector"].to_numpy()).astype(np.float64) @ matrix.T, DIGITS)
            scores[pdf["key"].to_numpy()[:, None] == np.array(names)[None, :]] = -np.inf  # not itself
            best = scores.max(axis=1)
            ok = best >= self.threshold
            yield pd.DataFrame({"key": pdf["key"].to_numpy()[ok], "best": best[ok]})


def near_any(vectors: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """``key, best`` of every vector whose dot product with some query (not itself) reaches the threshold."""
    return _by_blocks(vectors, queries, lambda shared: BlockMax(shared, threshold), "key {key}, best double").groupBy("key").agg(F.max("best").alias("best"))


def _by_blocks(vectors: DataFrame, queries: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make(broadcast block)`` finds in the vectors, over all blocks of the stated query set."""
    spark = vectors.sparkSession
    queries = queries.where("query is not null and vector is not null")
    passes = max(1, -(-queries.count() // QUERY_BLOCK))
    schema = schema.format(query=dict(queries.dtypes)["query"], key=dict(vectors.dtypes)["key"])
    held = vectors.where("key is not null and vector is not null").select("key", "vector", "grp")
    out = None
    for p in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p)
        rows = part.select("query", "vector", "grp").orderBy("query").collect()  # about QUERY_BLOCK rows
        if not rows:
            continue
        block = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64), [r[2] for r in rows]
        found = held.mapInPandas(make(spark.sparkContext.broadcast(block)), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = RETRIEVE_K) -> DataFrame:
    """``query, rank, key, score``: the k vectors of greatest dot product for each query, exactly.

    ``vectors`` has key, vector, grp; ``queries`` has query, vector and grp, one group or an array (null: any). Vectors are
    expected to have length 1, so the dot product is the cosine. Queries are a stated set and are
    scored block by block: a block is broadcast, every partition keeps its best k of each query, and
    only those are shuffled. Null vectors and queries are left out; ties go by key.
    """
    out = _by_blocks(vectors, queries, lambda shared: BlockTopK(shared, k), "query {query}, key {key}, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return out.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).select("query", "rank", "key", "score")


def hashed_features(docs: DataFrame, dims: int = 64) -> DataFrame:
    """``key, dim, value``: token counts of each text in hashed buckets, scaled to length 1; texts without tokens have none."""
    bucket = F.conv(F.substring(F.md5(F.col("token")), 1, 4), 16, 10).cast("bigint") % dims
    counts = docs.select("key", F.explode(tokens(F.col("text"))).alias("token")).groupBy("key", bucket.alias("dim")).agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("key")))
    return counts.select("key", "dim", (F.col("n") / length).alias("value"))


class HashedVectors:
    """Dense vectors of token lists: counts in hashed buckets, scaled to length 1."""

    def __init__(self, dims: int):
        self.dims = dims

    def __call__(self, batches):
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.dictionary_encode(lists.flatten())
            bucket = np.array([int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % self.dims for t in coded.dictionary.to_pylist()], dtype=np.int64)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            counts = np.bincount(row * self.dims + bucket[coded.indices.to_numpy()], minlength=batch.num_rows * self.dims).reshape(-1, self.dims).astype(np.float64)
            some = np.flatnonzero(lengths)
            unit = counts[some] / np.sqrt((counts[some] ** 2).sum(axis=1, keepdims=True))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * self.dims), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), vectors], names=["key", "vector"])


def hashed_vectors(docs: DataFrame, dims: int = 64) -> DataFrame:
    """``key, vector`` with the dense form of ``hashed_features``, in one scan; a key that comes twice has two rows."""
    return docs.select("key", tokens(F.col("text")).alias("toks")).mapInArrow(HashedVectors(dims), f"key {dict(docs.dtypes)['key']}, vector array<double>")


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = RETRIEVE_K, rrf_k: int = RRF_K) -> DataFrame:
    """``qid, rank, chunk_id, score`` from ranked lists ``(qid, rank, chunk_id)``.

    The score sums 1 / (rrf_k + rank). Equal scores keep the order of first appearance, earlier
    lists first. A chunk in several lists is one row; no lists' rows give no rows.
    """
    parts = [d.select("qid", "rank", "chunk_id", F.lit(i).alias("list_no")) for i, d in enumerate(lists)]
    rows = parts[0]
    for d in parts[1:]:
        rows = rows.unionByName(d)
    merged = rows.groupBy("qid", "chunk_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "chunk_id")
    return merged.withColumn("new_rank", F.row_number().over(best).cast("bigint")).where(F.col("new_rank") <= k).select("qid", F.col("new_rank").alias("rank"), "chunk_id", "score")


def overlap_logit(question: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder's logit: share of the question's distinct tokens in the text, from -4 to 4."""
    q, t = F.array_distinct(tokens(question)), F.array_distinct(tokens(text))
    return F.when(F.size(q) > 0, 8.0 * F.size(F.array_intersect(q, t)) / F.size(q) - 4.0).otherwise(F.lit(-4.0))


def rerank(candidates: DataFrame, alpha: float = BLEND_ALPHA) -> DataFrame:
    """``candidates(qid, rank, chunk_id, logit, ...)`` with new rank, score and raw_score.

    score = alpha * sigmoid(logit) + (1 - alpha) * (1 - (rank - 1) / n), n candidates of the question;
    equal scores keep the old order. A null logit counts as the least one.
    """
    n = F.count("*").over(Window.partitionBy("qid"))
    sigmoid = 1.0 / (1.0 + F.exp(-F.coalesce(F.col("logit"), F.lit(-1e9))))
    scored = candidates.withColumn("n", n).withColumn("score", F.round(alpha * sigmoid + (1 - alpha) * (1 - (F.col("rank") - 1) / F.col("n")), 9))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    rest = [c for c in candidates.columns if c not in ("qid", "rank", "chunk_id", "logit", "score")]
    return scored.select("qid", F.row_number().over(order).cast("bigint").alias("rank"), "chunk_id", "score", F.col("logit").alias("raw_score"), *rest)


def top_up(retrieved: DataFrame, compared: DataFrame, pools: DataFrame, k: int = TOPUP_K) -> DataFrame:
    """Retrieved rows plus up to k rows of every compared competition that has none.

    ``retrieved(qid, rank, chunk_id, competition)``, ``compared(qid, competition)``, ``pools(qid,
    competition, pool_rank, chunk_id)`` holds each question's best passages of each compared
    competition alone. Added rows rank after all others, by competition and pool rank; a chunk that
    is there already is not added.
    """
    present = retrieved.select("qid", "competition").distinct()
    missing = compared.select("qid", "competition").distinct().join(present, ["qid", "competition"], "left_anti")
    extra = pools.where(F.col("pool_rank") <= k).join(missing, ["qid", "competition"]).join(retrieved.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    last = retrieved.groupBy("qid").agg(F.max("rank").alias("last"))
    order = Window.partitionBy("qid").orderBy("competition", "pool_rank")
    added = extra.join(last, "qid", "left").select("qid", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("bigint").alias("rank"), "chunk_id", "competition")
    return retrieved.select("qid", "rank", "chunk_id", "competition").unionByName(added)


def wants_women(question: Column) -> Column:
    return question.rlike(r"(?i)\bwom[ae]n'?s?\b")


def select_context(ranked: DataFrame, compared: DataFrame, k: int = CONTEXT_K, cap: int = MAX_VARIANTS_PER_TITLE) -> DataFrame:
    """``qid, rank, chunk_id``: k passages per question, diverse by clause title.

    ``ranked(qid, rank, chunk_id, competition, gender, clause_title, women)``, ``compared(qid, position,
    competition)``. First each compared competition's best passage, of the wanted gender if there
    is one; then by rank, but of one title (case and outer blanks aside) at most ``cap`` different
    (competition, gender) variants; what the cap held back comes last. Output is in rank order.
    """
    by = Window.partitionBy("qid", "competition").orderBy(((F.col("gender") == "women") != F.col("women")).cast("int"), "rank")
    picks = ranked.join(compared, ["qid", "competition"]).withColumn("n", F.row_number().over(by)).where("n = 1")
    seeds = picks.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("position"))).where(F.col("n") <= k).select("qid", "rank", F.lit(1).alias("seed"))
    rows = ranked.join(seeds, ["qid", "rank"], "left").withColumn("seed", F.coalesce("seed", F.lit(0)))
    rows = rows.withColumn("title", F.lower(F.trim("clause_title"))).withColumn("variant", F.struct("competition", "gender"))
    per_title, per_variant = Window.partitionBy("qid", "title"), Window.partitionBy("qid", "title", "variant")
    rows = rows.withColumn("variant_seed", F.max("seed").over(per_variant)).withColumn("first", F.min(F.when(F.col("seed") == 0, F.col("rank"))).over(per_variant))
    seeded = F.size(F.collect_set(F.when(F.col("variant_seed") == 1, F.col("variant"))).over(per_title))  # at most k
    order = F.dense_rank().over(per_title.orderBy(F.col("variant_seed"), F.col("first").asc_nulls_last()))
    rows = rows.withColumn("seeded", seeded).withColumn("ord", order)
    priority = F.when(F.col("seed") == 1, 0).when((F.col("variant_seed") == 1) | (F.col("ord") + F.col("seeded") <= cap), 1).otherwise(2)
    best = Window.partitionBy("qid").orderBy(priority, "rank")
    return rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("qid", "rank", "chunk_id")
