"""Column expressions shared by operators on passages and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def passage(text: Column) -> Column:
    """The text after the first line feed; empty if there is none, null for null."""
    return F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise(F.when(text.isNotNull(), F.lit("")))


def clause_number(clause: Column) -> Column:
    """A clause number without its notation: ``Clause 6.2``, ``cl. 06.2`` and ``6 . 2.`` are ``6.2``.

    Letters of an appendix number stay, in lower case; null and values without digits give null.
    """
    # digits of other scripts and the full stop of full width, then their plain forms
    low = F.lower(F.translate(clause, "\u00a0０１２３４５６７８９．٠١٢٣٤٥٦٧٨٩०१२३४५६७८९", " 0123456789.01234567890123456789"))
    core = F.regexp_extract(low, r"((?<![a-z])[a-z]\s*[.\-]\s*)?\d+(\s*[.\-:/,·]\s*\d+)*", 0)
    dotted = F.regexp_replace(F.regexp_replace(core, r"\s+", ""), r"[\-:/,·]", ".")
    plain = F.regexp_replace(dotted, r"(^|\.)0+(?=\d)", "$1")
    return F.when(plain != "", plain)
