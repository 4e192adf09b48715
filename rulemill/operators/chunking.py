"""Construction of chunks from clause records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SIZE, OVERLAP, BATCH = 1_500, 150, 25
SEPARATORS = ("\n\n", "\n", " ", "")


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring parts to pieces of at most ``size``, each starting with a tail of the one before of at most ``overlap``."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    out.append("".join(held).strip())
    return [p for p in out if p]


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, separators=SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: at the first separator that occurs, finer ones inside parts too large.

    A separator stays at the start of the part after it. Pieces are stripped, empty ones dropped.
    """
    sep, finer = "", ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, finer = s, separators[i + 1 :]
            break
    if sep:
        cut = text.split(sep)
        parts = [p for p in [cut[0], *(sep + c for c in cut[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    good: list[str] = []
    for p in parts:
        if len(p) <= size:
            good.append(p)
            continue
        if good:
            out += _merge(good, size, overlap)
            good = []
        out += split_recursive(p, size, overlap, finer) if finer else [p.strip()]
    return out + (_merge(good, size, overlap) if good else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: split_recursive(t) if t else [])


def header(title: Column, clause: Column, clause_title: Column) -> Column:
    """``[title | Clause n name]`` without a blank before the bracket."""
    line = F.concat(F.lit("["), title, F.lit(" | Clause "), clause, F.lit(" "), clause_title, F.lit("]"))
    return F.regexp_replace(F.rtrim(line), r"\s+\]$", "]")


def build_chunks(records: DataFrame, sources: DataFrame) -> DataFrame:
    """The 17 columns of a chunk for every piece of every clause record.

    ``sources`` has one row per doc_id; gender defaults to all and status to active. Records of
    documents without a source have no chunks.
    """
    about = sources.select("doc_id", "title", "body", "competition", F.coalesce("gender", F.lit("all")).alias("gender"), "doc_type", F.col("effective_from").cast("string").alias("effective_from"), F.coalesce("status", F.lit("active")).alias("status"))
    rows = records.join(about, "doc_id").select("*", F.posexplode(split_pieces("text")).alias("chunk_index", "piece"))
    text = F.concat(header(F.col("title"), F.col("clause"), F.col("clause_title")), F.lit("\n"), F.col("piece"))
    rows = rows.withColumn("text", text)
    return rows.select(
        F.concat_ws("::", "doc_id", "clause", F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "body", "competition", "gender", "doc_type", "effective_from", "law_no", "clause",
        "clause_title", "section_path", "page_start", "page_end", "chunk_index", F.sha2("text", 256).alias("content_hash"), "status", "text",
    )


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """``doc_id, n_clauses, n_chunks, avg_length, max_length``."""
    return chunks.groupBy("doc_id").agg(F.countDistinct("clause").alias("n_clauses"), F.count("*").alias("n_chunks"), F.round(F.avg(F.length("text")), 6).alias("avg_length"), F.max(F.length("text")).cast("bigint").alias("max_length"))


def batches(chunks: DataFrame, size: int = BATCH) -> DataFrame:
    """``doc_id, chunk_id, batch_no``: batches of a fixed size within each document, by chunk_id."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id"))
    return chunks.select("doc_id", "chunk_id", F.floor((n - 1) / size).cast("bigint").alias("batch_no"))
