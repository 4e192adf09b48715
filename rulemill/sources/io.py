"""Sources and sinks: registries, pages, chunks, golden items, logs, key-value cache, reports."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill import schemas

#: The first bytes of every file that is taken for a PDF (fixed value).
PDF_MAGIC = b"%PDF-"
NO_INDEX = "unversioned"


def load_registry(spark: SparkSession, path: str, schema=schemas.SOURCES) -> DataFrame:
    """YAML list of records with an ``ord`` column; a missing file is an empty registry."""
    import yaml

    rows = []
    if Path(path).exists():
        rows = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    names = [f.name for f in schema]
    data = [(*(str(r[n]) if n == "effective_from" and r.get(n) is not None else r.get(n) for n in names), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, _with_ord(schema))


def _with_ord(schema):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([*schema.fields, StructField("ord", LongType())])


def save_registry(sources: DataFrame, path: str) -> None:
    """Write a registry (a small table by nature) as YAML in the order of ``ord``."""
    import yaml

    rows = [r.asDict() for r in sources.orderBy("ord").drop("ord").toLocalIterator()]
    Path(path).write_text(yaml.safe_dump(rows, sort_keys=False, allow_unicode=True), encoding="utf-8")


def last_of_each(sources: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Of repeated keys the last row."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return sources.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str, doc_ids: list[str] | None = None) -> DataFrame:
    """Chunks of all or of some documents; the filter prunes partitions of a table written by ``write_chunks``."""
    chunks = spark.read.schema(schemas.CHUNKS).parquet(path)
    return chunks.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else chunks


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the documents that occur in ``chunks`` and leave the others: dynamic partition overwrite by doc_id."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def excluding(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of documents that are not re-ingested."""
    return chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_anti")


def read_pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, is_pdf`` of binary files; what a page provider reads. Files without the magic bytes are kept and marked."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", (F.substring("content", 1, len(PDF_MAGIC)) == F.lit(bytearray(PDF_MAGIC))).alias("is_pdf"))


def extract_pages(files: DataFrame, provider) -> DataFrame:
    """``doc_id, page, text`` by a provider from bytes to a list of page texts; the file's stem is the doc_id."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(os.path.splitext(os.path.basename(p))[0], i + 1, t) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, t in enumerate(provider(bytes(c)))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return files.where("is_pdf").select("path", "content").mapInPandas(run, "doc_id string, page int, text string")


def read_golden(path: str) -> list[dict]:
    """Items of a JSONL file, blank lines skipped; a bad line is an error that names file and line."""
    out = []
    for n, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        if line.strip():
            try:
                item = json.loads(line)
                out.append({k: item[k] for k in ("id", "question", "competition", "type")} | {"gold": [(g["doc_id"], g["clause"]) for g in item.get("gold", [])], "answer_short": item.get("answer_short"), "notes": item.get("notes")})
            except (ValueError, KeyError, TypeError) as e:
                raise ValueError(f"{path}:{n}: {e}") from e
    return out


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log written by ``append_log``; a missing one is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception:  # Spark has no table there yet
        return spark.createDataFrame([], schema)


def cache_get(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """``questions(key, ...)`` with answer_json, null on a miss; of several writes of a key the latest."""
    latest = cache.groupBy("key").agg(F.max_by("answer_json", "written").alias("answer_json"))
    return questions.join(latest, "key", "left")


def cache_put(answers: DataFrame, path: str) -> None:
    """Append answers that are not errors; reading takes the latest, so nothing is rewritten in place."""
    answers.where(~F.coalesce("error", F.lit(False))).select("key", "answer_json", F.current_timestamp().alias("written")).write.mode("append").parquet(path)


def write_version(version: str, folder: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    temporary = Path(folder) / "index_version.txt.new"
    temporary.write_text(version, encoding="utf-8")
    temporary.replace(Path(folder) / "index_version.txt")


def read_version(folder: str, missing: str = NO_INDEX) -> str:
    path = Path(folder) / "index_version.txt"
    return path.read_text(encoding="utf-8").strip() if path.exists() else missing


def write_report(metrics: DataFrame, failures: DataFrame, folder: str) -> None:
    """Metrics as JSON lines and failures as CSV with a header."""
    metrics.write.mode("overwrite").json(f"{folder}/results")
    failures.write.mode("overwrite").option("header", True).csv(f"{folder}/failures")


def write_training_set(rows: DataFrame, folder: str) -> DataFrame:
    """Rows as JSON by split, and a one-row table of counts."""
    rows.write.mode("overwrite").partitionBy("split").json(f"{folder}/rows")
    info = rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("qid").alias("n_questions"), F.sum("label").alias("n_positive"))
    info.write.mode("overwrite").json(f"{folder}/dataset_info")
    return info
