"""Splits that keep related records together (problem 4)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulemill.functions.subset_sum import nearest_subset
from rulemill.operators.components import connected_components
from rulemill.session import cut, table

SPLITS = (("test", 0.1), ("val", 0.1), ("train", 0.8))
#: Components of one size are taken in hashed cells of at most about so many, so that the many small ones share no task.
CELL_ROWS, LEAST_SALTS = 500_000, 16


def document_links(questions: DataFrame) -> DataFrame:
    """``a, b``: each document linked to the least document that shares a passage with it (itself among others)."""
    held = questions.select("doc_id", "pos_chunk_id").where("doc_id is not null").distinct()
    least = held.where("pos_chunk_id is not null").groupBy("pos_chunk_id").agg(F.min("doc_id").alias("b"))
    tied = held.where("pos_chunk_id is not null").join(least, "pos_chunk_id").select(F.col("doc_id").alias("a"), "b").distinct()
    return tied.union(held.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).distinct())


def question_groups(questions: DataFrame) -> DataFrame:
    """``qid, component`` of every distinct non-null qid.

    Questions that share a doc_id or a pos_chunk_id (null ties nothing), directly or through others,
    have one component. Its name is ``doc:`` and the least doc_id, else ``chunk:`` and the passage,
    else ``qid:`` and the question. A qid whose rows differ ties what its rows name.
    """
    rows = questions.select("qid", "doc_id", "pos_chunk_id").where("qid is not null").distinct()
    # a qid whose rows name several documents or passages ties them
    docs = rows.where("doc_id is not null").select(F.concat(F.lit("doc:"), "doc_id").alias("x"), "qid", "pos_chunk_id", "doc_id")
    named = docs.select(F.col("x").alias("doc_id"), "pos_chunk_id")
    spread = rows.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").join(rows, "qid")
    own = F.concat(F.lit("qid:"), "qid")
    extra = spread.where("doc_id is not null").select(F.concat(F.lit("doc:"), "doc_id").alias("a"), own.alias("b")).union(
        spread.where("pos_chunk_id is not null").select(F.concat(F.lit("chunk:"), "pos_chunk_id").alias("a"), own.alias("b"))
    )
    least = named.where("pos_chunk_id is not null").groupBy("pos_chunk_id").agg(F.min("doc_id").alias("first_doc"))
    chunk_ties = least.join(extra.where("a like 'chunk:%'").select(F.expr("substring(a, 7)").alias("pos_chunk_id")).distinct(), "pos_chunk_id", "left_semi").select(
        F.concat(F.lit("chunk:"), "pos_chunk_id").alias("a"), F.col("first_doc").alias("b")
    )
    labels = connected_components(document_links(named).union(extra).union(chunk_ties)).withColumnRenamed("node", "x")
    keyed = rows.join(least, "pos_chunk_id", "left").select(
        "qid",
        F.coalesce(F.concat(F.lit("doc:"), "doc_id"), "first_doc", F.concat(F.lit("chunk:"), "pos_chunk_id"), own).alias("x"),
    )
    return keyed.join(labels, "x", "left").groupBy("qid").agg(F.min(F.coalesce("component", "x")).alias("component"))


def _choose(frame: pd.DataFrame) -> pd.DataFrame:
    """Of the (size, salt) cells of all components: how many of each go to test and to val."""
    frame = frame.sort_values(["size", "salt"], ignore_index=True)
    by_size = frame.groupby("size")["n"]
    left = by_size.sum().astype(int).to_dict()
    total = sum(s * c for s, c in left.items())
    out = frame[["size", "salt"]].copy()
    done = pd.Series(0, index=frame.index)
    for name, share in SPLITS[:-1]:
        take = nearest_subset(list(left), list(left.values()), round(total * share), may_exceed=True)
        left = {s: c - take.get(s, 0) for s, c in left.items()}
        room = frame["n"] - done
        before = room.groupby(frame["size"]).cumsum() - room
        here = (frame["size"].map(lambda s, take=take: take.get(int(s), 0)) - before).clip(lower=0)
        here = here.where(here < room, room)
        out[name] = here.astype("int64")
        done += here
    return out


def assign_splits(questions: DataFrame, seed: int = 42) -> DataFrame:
    """``qid, component, split``: train, val and test at 80, 10 and 10 percent of the qids, whole components.

    The sizes of components with their multiplicities (at most as many as the square root of twice
    the questions) decide how many of each size go to test and val, by subset-sum bitsets; a seeded
    hash decides which. A component above its target's reach stays in train. Null qids are left
    out; an empty table gives no rows.
    """
    groups = cut(question_groups(questions))
    order = F.xxhash64(F.col("component"), F.lit(seed))
    sizes = cut(groups.groupBy("component").agg(F.count("*").alias("size")))
    salts = max(LEAST_SALTS, sizes.count() // CELL_ROWS)
    sizes = sizes.withColumn("salt", F.pmod(order, F.lit(salts)).cast("int"))
    cells = sizes.groupBy("size", "salt").agg(F.count("*").alias("n"))
    plan = cells.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_choose, "size bigint, salt int, test bigint, val bigint")
    place = F.row_number().over(Window.partitionBy("size", "salt").orderBy(order, "component"))
    split = F.when(F.col("place") <= F.col("test"), "test").when(F.col("place") <= F.col("test") + F.col("val"), "val").otherwise("train")
    chosen = sizes.withColumn("place", place).join(plan, ["size", "salt"]).select("component", split.alias("split"))
    return groups.join(chosen, "component").select("qid", "component", "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """``split, n_questions, n_components, share`` of the three splits."""
    total = assigned.agg(F.count("*").alias("total"))
    per = assigned.groupBy("split").agg(F.count("*").alias("n_questions"), F.countDistinct("component").alias("n_components"))
    return per.crossJoin(F.broadcast(total)).select("split", "n_questions", "n_components", (F.col("n_questions") / F.col("total")).alias("share"))  # one row


def tied_documents(questions: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b``, smaller first: all pairs of different documents in one component."""
    labels = cut(connected_components(document_links(questions.where("qid is not null"))))
    a = labels.select(F.col("node").alias("doc_id_a"), "component")
    b = labels.select(F.col("node").alias("doc_id_b"), "component")
    return a.join(b, "component").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def p4_found(spark, sf_dir: str) -> DataFrame:
    return tied_documents(table(spark, sf_dir, "synthetic_questions"))


def p4_splits(spark, sf_dir: str) -> DataFrame:
    return assign_splits(table(spark, sf_dir, "synthetic_questions"))


def p4_shares(spark, sf_dir: str) -> DataFrame:
    return split_report(assign_splits(table(spark, sf_dir, "synthetic_questions")))


def p4_invariants(spark, sf_dir: str) -> DataFrame:
    """``n_qids, n_twice, n_torn_documents, n_torn_passages`` of the whole assignment: all but the first must be 0."""
    questions = table(spark, sf_dir, "synthetic_questions").where("qid is not null")
    given = cut(assign_splits(questions).select("qid", "split"))
    held = questions.select("qid", "doc_id", "pos_chunk_id").join(given, "qid", "left")
    torn = [held.where(f"{c} is not null").groupBy(c).agg(F.countDistinct("split").alias("n")).agg(F.coalesce(F.sum((F.col("n") != 1).cast("bigint")), F.lit(0)).alias(name)) for c, name in (("doc_id", "n_torn_documents"), ("pos_chunk_id", "n_torn_passages"))]
    whole = given.agg(F.countDistinct("qid").alias("n_qids"), (F.count("*") - F.countDistinct("qid")).alias("n_twice"))
    return whole.crossJoin(F.broadcast(torn[0])).crossJoin(F.broadcast(torn[1]))  # one row each
