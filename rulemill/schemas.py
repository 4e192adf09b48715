"""Declared schemas of the engine's tables."""

from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType


def _text(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


SOURCES = StructType([*_text("doc_id", "title", "body", "competition", "gender", "doc_type", "effective_from", "url"), StructField("manual", BooleanType()), *_text("status")])
PAGES = StructType([*_text("doc_id"), StructField("page", IntegerType()), *_text("text")])
CHUNKS = StructType(
    [
        *_text("chunk_id", "doc_id", "body", "competition", "gender", "doc_type", "effective_from"),
        StructField("law_no", IntegerType()),
        *_text("clause", "clause_title", "section_path"),
        *(StructField(n, IntegerType()) for n in ("page_start", "page_end", "chunk_index")),
        *_text("content_hash", "status", "text"),
    ]
)
CHUNK_COLUMNS = CHUNKS.fieldNames()
