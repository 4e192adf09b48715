"""Cleaning of pages into lines, boilerplate removal and heading tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPEAT_SHARE = 0.5
#: Patterns of page furniture and headings (fixed values).
PAGE_NUMBER = r"(?i)^\s*(page\s*)?\d+\s*((of|/)\s*\d+)?\s*$"
DOT_LEADER = r"\.{3,}\s*\d+\s*$"
CONTROL = r"[\x00-\x08\x0b-\x1f ]"
LAW_HEADING = r"^LAW\s+(\d{1,2})\s+(.+)$"
APPENDIX_HEADING = r"(?i)^APPENDIX\s+([A-Z])[:.]?\s+(.+)$"
APPENDIX_LETTER = r"(?i)^APPENDIX\s+([A-Z])$"
SECTION_INLINE = r"^(\d{1,2})\s+([A-Z][A-Z0-9 ,;'\-.&()]{2,80})$"
SECTION_NUMBER = r"^(\d{1,2})$"
CLAUSE_NUMERIC = r"^(\d{1,3}\.\d{1,3})(?:\s+(.+))?$"
CLAUSE_APPENDIX = r"^([A-Z]\.\d{1,3})(?:\s+(.+))?$"
SUBCLAUSE = r"^\d{1,3}(?:\.\d{1,3}){2,}\b"
SUBCLAUSE_APPENDIX = r"^[A-Z](?:\.\d{1,3}){2,}\b"
#: Line ends that page cleaning splits at, beyond the line feed (fixed values).
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(col: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_line(col: Column) -> Column:
    """Control characters and no-break spaces become blanks, runs of blanks and tabs one blank, ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(col, CONTROL, " "), r"[ \t]+", " "))


def page_lines(pages: DataFrame, ends: str = LINE_ENDS) -> DataFrame:
    """``doc_id, page, line_no, raw`` of ``pages(doc_id, page, text)``; null texts have no lines."""
    return pages.select("doc_id", "page", F.posexplode(F.split("text", ends)).alias("line_no", "raw"))


def repeated_lines(pages: DataFrame, share: float = REPEAT_SHARE) -> DataFrame:
    """``doc_id, line, n_pages`` of lines on more than ``share`` of a document's pages.

    A line counts once per page, blanks at its ends aside; empty lines never count. On a document of
    one page every line is repeated.
    """
    total = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("total"))
    lines = page_lines(pages).select("doc_id", "page", strip(F.col("raw")).alias("line")).where("line <> ''").distinct()
    counts = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n_pages"))
    return counts.join(total, "doc_id").where(F.col("n_pages") > share * F.col("total")).select("doc_id", "line", "n_pages")


def clean_pages(pages: DataFrame, share: float = REPEAT_SHARE) -> DataFrame:
    """``doc_id, page, text`` with blank lines, repeated lines and page numbers removed; pages left empty have the empty text."""
    lines = page_lines(pages).withColumn("line", strip(F.col("raw"))).where((F.col("line") != "") & ~F.col("line").rlike(PAGE_NUMBER))
    kept = lines.join(repeated_lines(pages, share).select("doc_id", "line"), ["doc_id", "line"], "left_anti")
    joined = kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select("doc_id", "page").distinct().join(joined, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))


def normalized_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page, line_no, line``: lines at line feeds only, normalised; contents entries and empty lines dropped."""
    lines = page_lines(pages, "\n").where(~F.col("raw").rlike(DOT_LEADER)).withColumn("line", normalize_line(F.col("raw")))
    return lines.where("line <> ''").select("doc_id", "page", "line_no", "line")


def is_upper_title(col: Column) -> Column:
    """At least one letter, and no letter that upper-casing would change."""
    return (col == F.upper(col)) & col.rlike(r"\p{L}")


def looks_like_title(col: Column) -> Column:
    return col.rlike(r'^[\p{Lu}("]')


def heading_kind(line: Column) -> Column:
    """law, appendix, section, clause, subclause or body, by the form of the line alone."""
    rest = F.regexp_extract(line, CLAUSE_NUMERIC, 2)
    return (
        F.when(line.rlike(APPENDIX_HEADING) | line.rlike(APPENDIX_LETTER), "appendix")
        .when(line.rlike(LAW_HEADING) & is_upper_title(F.regexp_extract(line, LAW_HEADING, 2)), "law")
        .when(line.rlike(SECTION_INLINE) & is_upper_title(F.regexp_extract(line, SECTION_INLINE, 2)), "section")
        .when(line.rlike(CLAUSE_NUMERIC) & ((rest == "") | looks_like_title(rest)), "clause")
        .when(line.rlike(CLAUSE_APPENDIX), "clause")
        .when(line.rlike(SUBCLAUSE) | line.rlike(SUBCLAUSE_APPENDIX), "subclause")
        .otherwise("body")
    )


def increasing(candidates: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Candidates whose value exceeds all earlier ones of their group, which equals exceeding the last accepted one."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return candidates.withColumn("__top", F.max(value).over(w)).where(F.col("__top").isNull() | (F.col(value) > F.col("__top"))).drop("__top")


def longest_per_clause(records: DataFrame) -> DataFrame:
    """Of ``records(doc_id, clause, ord, text, ...)`` the longest text of each clause, the first of equals."""
    w = Window.partitionBy("doc_id", "clause").orderBy(F.desc(F.length("text")), "ord")
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
