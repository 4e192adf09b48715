"""Segmentation of a document's lines into clauses: a line machine per document."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.operators import textprep as tp

#: Limits on titles (fixed values).
MIN_APPENDIX_TITLE, APPENDIX_TITLE_LINES, SHORT_TITLE, LONG_TITLE = 8, 2, 40, 80
SCHEMA = "doc_id string, law_no int, clause string, clause_title string, section_path string, page_start int, page_end int, text string"
_FORM = {name: re.compile(getattr(tp, name)) for name in ("LAW_HEADING", "APPENDIX_HEADING", "APPENDIX_LETTER", "SECTION_INLINE", "SECTION_NUMBER", "CLAUSE_NUMERIC", "CLAUSE_APPENDIX", "SUBCLAUSE", "SUBCLAUSE_APPENDIX")}
_HEADINGS = ("APPENDIX_HEADING", "APPENDIX_LETTER", "LAW_HEADING", "SECTION_INLINE", "CLAUSE_NUMERIC", "CLAUSE_APPENDIX")
_NUMBERS = ("CLAUSE_NUMERIC", "CLAUSE_APPENDIX", "SUBCLAUSE", "SUBCLAUSE_APPENDIX")


def _form(name: str, line: str):
    return _FORM[name].match(line)


def _any(names, line: str) -> bool:
    return any(_form(n, line) for n in names)


def _capitals(text: str) -> bool:
    return text == text.upper() and any(map(str.isalpha, text))


def _title(text: str) -> bool:
    return bool(text) and (text[0].isupper() or text[0] in '("')


@dataclass
class Machine:
    """Reads ``(page, line)`` pairs in order; ``run`` gives the records of one document."""

    lines: list[tuple[int, str]]
    records: list[dict] = field(default_factory=list)
    front: list[tuple[int, str]] = field(default_factory=list)
    open: dict | None = None
    section: str = ""
    law: int = -1
    number: int | None = None
    letter: str | None = None
    appendix: bool = False

    def run(self) -> list[dict]:
        at = 0
        while at < len(self.lines):
            for rule in (self._appendix, self._law, self._section, self._clause):
                used = rule(at)
                if used:
                    break
            else:
                used = self._body(at)
            at += used
        last = self.lines[-1][0] if self.lines else 1
        self._close(last)
        if self.front:
            page = self.front[0][0]
            end = self.records[0]["page_start"] if self.records else last
            head = {"law_no": -1, "clause": "preamble", "clause_title": "Preamble", "section_path": "Preamble", "page_start": page or 1, "page_end": end, "text": "\n".join(t for _, t in self.front)}
            self.records.insert(0, head)
        return self.records

    # -- pieces of state

    def _close(self, page_end: int) -> None:
        """Emit the open clause if it has a body."""
        if self.open and self.open["body"]:
            done = dict(self.open)
            done["text"] = "\n".join(done.pop("body"))
            self.records.append(done | {"page_end": page_end})
        self.open = None

    def _begin_section(self, at: int, path: str, law: int, appendix: bool) -> None:
        self._close(self.lines[at - 1][0] if at else self.lines[at][0])
        self.section, self.law, self.appendix = path, law, appendix
        if not appendix:
            self.number = law

    def _body(self, at: int) -> int:
        if self.open:
            self.open["body"].append(self.lines[at][1])
        else:
            self.front.append(self.lines[at])
        return 1

    def _next(self, at: int) -> str | None:
        """The next line if it stands on the same or the following page."""
        if at + 1 < len(self.lines) and self.lines[at + 1][0] - self.lines[at][0] in (0, 1):
            return self.lines[at + 1][1]
        return None

    def _rises(self, n: int) -> bool:
        return self.number is None or n > self.number

    # -- rules: each gives the number of lines it took, 0 if it does not apply

    def _appendix(self, at: int) -> int:
        line, used = self.lines[at][1], 1
        if m := _form("APPENDIX_HEADING", line):
            letter, title = m.group(1).upper(), m.group(2).strip()
        elif m := _form("APPENDIX_LETTER", line):
            letter, follow = m.group(1).upper(), [t for _, t in self.lines[at + 1 : at + 1 + APPENDIX_TITLE_LINES]]
            parts: list[str] = []
            for t in follow:
                if _any(_HEADINGS, t) or not _capitals(t):
                    break
                parts.append(t)
            if not parts and follow and not _any(_HEADINGS, follow[0]) and 2 <= len(follow[0]) <= SHORT_TITLE:
                parts = follow[:1]
            title, used = " ".join(parts), 1 + len(parts)
        else:
            return 0
        if len(title) < MIN_APPENDIX_TITLE or self.number is None or (self.letter is not None and letter <= self.letter):
            return 0
        self._begin_section(at, f"APPENDIX {letter} {title}", -1, True)
        self.letter = letter
        return used

    def _law(self, at: int) -> int:
        m = _form("LAW_HEADING", self.lines[at][1])
        if not m or not _capitals(m.group(2)) or not self._rises(int(m.group(1))):
            return 0
        self._begin_section(at, f"LAW {int(m.group(1))} {m.group(2).strip()}", int(m.group(1)), False)
        return 1

    def _section(self, at: int) -> int:
        line = self.lines[at][1]
        if (m := _form("SECTION_INLINE", line)) and self._rises(int(m.group(1))) and _capitals(m.group(2)):
            self._begin_section(at, f"{int(m.group(1))} {m.group(2).strip()}", int(m.group(1)), False)
            return 1
        follow = self._next(at)
        if (m := _form("SECTION_NUMBER", line)) and follow and self._rises(int(m.group(1))) and _capitals(follow) and len(follow) <= LONG_TITLE:
            self._begin_section(at, f"{int(m.group(1))} {follow}", int(m.group(1)), False)
            return 2
        return 0

    def _clause(self, at: int) -> int:
        page, line = self.lines[at]
        own = _form("CLAUSE_APPENDIX", line) if self.appendix else None
        m = own or _form("CLAUSE_NUMERIC", line)
        if not m:
            return 0
        name = m.group(1) if own or not self.appendix else f"{self.letter}-{m.group(1)}"
        title, used = (m.group(2) or "").strip(), 1
        if title and not _title(title):
            return self._body(at)  # a decimal inside prose
        if not title:
            follow = self._next(at)
            if follow and not _any(_NUMBERS, follow) and len(follow) <= LONG_TITLE and _title(follow):
                title, used = follow, 2
        self._close(self.lines[at - 1][0] if at else page)
        self.open = {"law_no": self.law, "clause": name, "clause_title": title, "section_path": f"{self.section} > {name}" if self.section else name, "page_start": page, "body": []}
        return used


def segment_lines(lines: list[tuple[int, str]]) -> list[dict]:
    """Records of one document's normalised lines, before the longest of each clause is chosen."""
    return Machine(lines).run()


def _document(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["page", "line_no"])
    rows = segment_lines(list(zip(pdf["page"].astype(int), pdf["line"], strict=True)))
    best: dict[str, dict] = {}
    for r in rows:  # the longest of each clause, in the order of first appearance
        if r["clause"] not in best or len(r["text"]) > len(best[r["clause"]]["text"]):
            best[r["clause"]] = r
    out = pd.DataFrame(list(best.values()), columns=["law_no", "clause", "clause_title", "section_path", "page_start", "page_end", "text"])
    out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
    return out


def segment_documents(pages: DataFrame) -> DataFrame:
    """Clause records of ``pages(doc_id, page, text)``, one document per task call.

    A document is one rulebook; the state machine needs its lines in order, so its lines, not the
    corpus, must fit in a task. Documents without lines have no records. Null pages are dropped.
    """
    lines = tp.normalized_lines(pages.where("doc_id is not null and page is not null")).select("doc_id", F.col("page").cast("int").alias("page"), "line_no", "line")
    return lines.groupBy("doc_id").applyInPandas(_document, SCHEMA)
