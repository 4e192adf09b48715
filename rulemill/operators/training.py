"""Training sets for a reranker: subsets, negatives, leakage guard, splits by group, rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBSET_SIZE, SUBSET_SEED = 600, 42
NEGATIVES, FALSE_NEGATIVE, LEAKED = 4, 0.97, 0.85
TRAIN_SHARE = 0.9


def competition_label(competition: Column, gender: Column) -> Column:
    """Readable name of a competition and gender, null for the base laws and unknown ones (fixed values)."""
    whose = F.when(gender == "women", "women's").when(gender == "men", "men's")
    names = {"ipl": "the IPL", "icc_t20i": "T20Is", "icc_test": "Test matches", "icc_odi": "ODIs", "bcci_domestic_multiday": "domestic multi-day matches", "bcci_domestic_odi": "domestic one-day matches", "bcci_domestic_t20": "domestic T20 matches"}
    label = F.coalesce(*[F.when(competition == k, F.lit(v)) for k, v in names.items()])
    return F.when(label.isNotNull() & whose.isNotNull() & (competition != "ipl"), F.concat_ws(" ", whose, label)).otherwise(label)


def question_prompts(chunks: DataFrame, size: int = 25, least: int = 2, most: int = 3) -> DataFrame:
    """``doc_id, batch_no, chunk_ids, prompt``: numbered passages of each batch and what is asked of a provider."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id"))
    rows = chunks.withColumn("at", n - 1).withColumn("batch_no", F.floor(F.col("at") / size)).withColumn("no", F.col("at") % size + 1)
    label = F.coalesce(competition_label(F.col("competition"), F.col("gender")), F.lit("the laws"))
    part = F.concat(F.lit("["), F.col("no").cast("string"), F.lit("] ("), label, F.lit(") "), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("no", "chunk_id", part.alias("part"))))  # size rows
    head = F.lit(f"Write {least} to {most} questions that each numbered passage answers.\n\n")
    return rows.groupBy("doc_id", "batch_no").agg(parts.alias("x")).select("doc_id", "batch_no", F.transform("x", lambda v: v["chunk_id"]).alias("chunk_ids"), F.concat(head, F.array_join(F.transform("x", lambda v: v["part"]), "\n\n")).alias("prompt"))


def generate_questions(prompts: DataFrame, provider, tries: int = 5, wait: float = 2.0) -> DataFrame:
    """``qid, question, pos_chunk_id`` from a provider of ``prompt -> {passage number: [questions]}``.

    A failing batch is tried again with doubled waits and then gives nothing; a passage that the
    answer leaves out has no questions. The k-th question of a passage is ``syn_{chunk}_{k}``.
    """
    import time

    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for ids, prompt in zip(pdf["chunk_ids"], pdf["prompt"], strict=True):
                said = {}
                for t in range(tries):
                    try:
                        said = provider(prompt)
                        break
                    except Exception:  # providers raise their own kinds
                        if t + 1 < tries:
                            time.sleep(wait * 2**t)
                rows += [(f"syn_{c}_{k}", q, c) for no, c in enumerate(ids, 1) for k, q in enumerate(said.get(no, []), 1)]
            yield pd.DataFrame(rows, columns=["qid", "question", "pos_chunk_id"])

    return prompts.select("chunk_ids", "prompt").mapInPandas(run, "qid string, question string, pos_chunk_id string")


def stratified_subset(chunks: DataFrame, size: int = SUBSET_SIZE, seed: int = SUBSET_SEED) -> DataFrame:
    """``chunk_id, doc_id``: round robin over documents, each in a seeded hash order, up to ``size`` rows in all."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), "chunk_id"))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "chunk_id"))
    return chunks.withColumn("turn", turn).orderBy("turn", "doc_id").limit(size).select("chunk_id", "doc_id")


def leaked(questions: DataFrame, golden_nearest: DataFrame, threshold: float = LEAKED) -> DataFrame:
    """Keys of ``questions`` whose nearest golden similarity reaches the threshold; a null similarity does not."""
    return questions.join(golden_nearest.where(F.col("score") >= threshold).select("key").distinct(), "key", "left_semi")


def hard_negatives(ranked: DataFrame, keep: int = NEGATIVES, false_negative: float = FALSE_NEGATIVE) -> DataFrame:
    """``query, key, n``: per query the first ``keep`` candidates by rank that are not positives.

    ``ranked(query, rank, key, positive, named, similarity)``: where the question names no competition
    (``named`` false) candidates as near to the positive as ``false_negative`` are dropped too.
    """
    rows = ranked.where(~F.col("positive") & (F.col("named") | F.coalesce(F.col("similarity") < false_negative, F.lit(True))))
    n = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return rows.withColumn("n", n.cast("bigint")).where(F.col("n") <= keep).select("query", "key", "n")


def positive_chunks(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """``qid, chunk_id``: the chunks of the document and clause that ``gold(qid, doc_id, clause)`` names; null fields name none."""
    return gold.select("qid", "doc_id", "clause").join(chunks.select("chunk_id", "doc_id", "clause"), ["doc_id", "clause"]).select("qid", "chunk_id").distinct()


def group_split(groups: DataFrame, share: float = TRAIN_SHARE, seed: int = SUBSET_SEED, salts: int = 256) -> DataFrame:
    """``grp, split``: distinct groups in seeded hash order, the first ``share`` (half to even) train, the rest val.

    The order is taken in ranges of the hash, so no task sorts all groups.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), "grp"))
    rows = groups.select("grp").where("grp is not null").distinct().withColumn("h", h).withColumn("range", F.conv(F.substring("h", 1, 2), 16, 10).cast("int"))
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"))  # at most 256 rows
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "before")
    total = sizes.agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", "grp")) + F.col("before")
    ranked = rows.join(F.broadcast(before), "range").crossJoin(F.broadcast(total))
    return ranked.withColumn("place", place).select("grp", F.when(F.col("place") <= F.bround(F.col("total") * share), "train").otherwise("val").alias("split"))


def training_rows(questions: DataFrame, negatives: DataFrame, chunks: DataFrame) -> DataFrame:
    """``qid, query, chunk_id, label``: the positive passage and the negatives of every question.

    A question without text or whose positive is missing has no rows; a negative that is missing, or is
    the positive, is skipped; repeated rows count once.
    """
    known = chunks.select("chunk_id").distinct()
    asked = questions.where("qid is not null and question is not null").select("qid", F.col("question").alias("query"), "pos_chunk_id").distinct()
    asked = asked.join(known.withColumnRenamed("chunk_id", "pos_chunk_id"), "pos_chunk_id", "left_semi")
    mined = negatives.select("qid", F.explode("negative_chunk_ids").alias("chunk_id")).distinct()
    wrong = mined.join(asked, "qid").where("chunk_id <> pos_chunk_id").join(known, "chunk_id", "left_semi")
    return asked.select("qid", "query", F.col("pos_chunk_id").alias("chunk_id"), F.lit(1).alias("label")).unionByName(wrong.select("qid", "query", "chunk_id", F.lit(0).alias("label")))


def evaluator_groups(rows: DataFrame) -> DataFrame:
    """``qid, n_positive, n_negative`` of queries that have both."""
    return rows.groupBy("qid").agg(F.sum("label").alias("n_positive"), F.sum(1 - F.col("label")).alias("n_negative")).where("n_positive > 0 and n_negative > 0")


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``work`` whose key is not in the log of what is done."""
    return work.join(done.select(key).distinct(), key, "left_anti")
