"""Splitting oversized items at natural boundaries (problem 5): structure-tree packing.

Headings, lists and paragraphs of a text make a tree, kept as its boundaries with their depth. A node
within the limit stays whole; only an oversized node opens into its children, of which neighbours are
merged up to the limit, as evenly as the least number of pieces allows. Below lines a node opens
at sentences, then clauses, then words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.functions.texts import passage
from rulemill.session import table

LIMIT, OVERLAP = 1_500, 150
#: Pieces under this share of the limit join a neighbour that has room.
SMALL = 0.25
#: Depths: headings have 1 to 9, then paragraphs, items of nested lists, lines, and what is found only where a line is too long.
PARAGRAPH, ITEM, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 10, 20, 40, 50, 60, 70, 80
MARKUP = re.compile(r"[ \t]{0,3}(?:(#{1,6})[ \t]+\S|<h([1-6])\b)", re.I)
NAMED = re.compile(r"[ \t]*(?:(PART|CHAPTER|APPENDIX)|LAW|SECTION|ARTICLE)\b")
NUMBERED = re.compile(r"[ \t]*(\d+(?:\.\d+)+)\.?[ \t]+\S")
LIST_ITEM = re.compile(r"([ \t]*)(?:([-•*–])|(\(?)(\d{1,3}|[A-Za-z]|[ivxlc]{2,5})([.)]))[ \t]+\S")
#: White space, in a form that SQL engines share.
WHITE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
FINER = (
    (SENTENCE, re.compile(r"(?<=[.!?؟।]\s)(?=\S)|(?<=[.!?][\"”’)\]]\s)(?=\S)|(?<=[。！？])(?=\S)")),
    (CLAUSE, re.compile(r"(?<=[,;:、，；：]\s)(?=\S)|(?<=[、，；：])(?=\S)")),
    (WORD, re.compile(r"(?<=\s)(?=\S)")),
)


def _heading(line: str) -> int:
    """Depth of a heading line, 0 for any other."""
    if m := MARKUP.match(line):
        return len(m.group(1)) if m.group(1) else int(m.group(2))
    if m := NAMED.match(line):
        return 1 if m.group(1) else 2
    if m := NUMBERED.match(line):
        return min(9, 2 + m.group(1).count("."))
    return 0


def _style(m: re.Match, before: tuple[str, str] | None) -> tuple[str, str]:
    """Kind of a list mark, and the mark; a single i, v or x goes on with letters if the letter before it came last."""
    if m.group(2):
        return m.group(2), m.group(2)
    mark = m.group(4)
    follows = before is not None and before[0][1:2] in "aA" and len(mark) == 1 and ord(mark) == ord(before[1]) + 1
    kind = "9" if mark.isdigit() else "i" if re.fullmatch("[ivxlc]+", mark) and not follows else "a" if mark.islower() else "A"
    return m.group(3) + kind + m.group(5), mark


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places and depths of the structure's boundaries: the start of every line, as deep as what begins there."""
    places, depths = [], []
    lists: list[tuple[int, str]] = []  # indent and kind of the marks of the open lists
    last: tuple[str, str] | None = None
    at, blank = 0, False
    for line in text.splitlines(keepends=True):
        if not line.strip():
            at, blank = at + len(line), True
            continue
        heading = _heading(line)
        item = None if heading else LIST_ITEM.match(line)
        if heading:
            depth, lists, last = heading, [], None
        elif item:
            indent = len(item.group(1).expandtabs(4))
            kind, mark = last = _style(item, last)
            fresh = not lists
            while lists and lists[-1][0] > indent:
                lists.pop()
            if (indent, kind) in lists:
                del lists[lists.index((indent, kind)) + 1 :]
            else:
                lists.append((indent, kind))
            depth = PARAGRAPH if fresh and blank else min(LINE - 1, ITEM + len(lists))
        elif blank and not (lists and line[0] in " \t"):
            depth, lists, last = PARAGRAPH, [], None
        else:
            depth = LINE
        places.append(at)
        depths.append(depth)
        at, blank = at + len(line), False
    return places, depths


class Tree:
    """The structure of one text, and its packing into spans of at most ``limit`` characters."""

    def __init__(self, text: str, limit: int):
        self.text, self.limit = text, limit
        self.places, self.depths = boundaries(text)

    def children(self, a: int, e: int) -> tuple[list[int], int]:
        """Edges of a node's children, and their depth."""
        x, y = bisect_right(self.places, a), bisect_left(self.places, e)
        if x < y:
            depth = min(self.depths[x:y])
            return [a, *(p for p, d in zip(self.places[x:y], self.depths[x:y], strict=True) if d == depth), e], depth
        for depth, pattern in FINER:
            cuts = [m.start() for m in pattern.finditer(self.text, a, e) if a < m.start() < e]
            if cuts:
                return [a, *cuts, e], depth
        return [*range(a, e, self.limit), e], CHARACTER

    def pack(self, a: int, e: int) -> list[tuple[int, int, int]]:
        """``(start, end, depth of the cut before it)`` of the pieces of a node."""
        if e - a <= self.limit:
            return [(a, e, 0)]
        edges, depth = self.children(a, e)
        out: list[tuple[int, int, int]] = []
        run = [a]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y - x <= self.limit:
                run.append(y)
                continue
            out += self._merged(run, depth)
            opened = self.pack(x, y)
            out += [(x, opened[0][1], depth), *opened[1:]]
            run = [y]
        return self._joined(out + self._merged(run, depth))

    def _merged(self, edges: list[int], depth: int) -> list[tuple[int, int, int]]:
        """Neighbouring whole siblings merged: as few pieces as fit, the largest of them as small as can be."""
        if len(edges) < 2:
            return []

        def cuts(cap: int) -> list[int]:
            out = [edges[0]]
            while out[-1] < edges[-1]:
                k = bisect_right(edges, out[-1] + cap) - 1
                out.append(edges[k] if edges[k] > out[-1] else edges[k + 1])
            return out

        best = cuts(self.limit)
        low, high = max(y - x for x, y in zip(edges[:-1], edges[1:], strict=True)), self.limit
        while low < high:
            cap = (low + high) // 2
            tried = cuts(cap)
            if len(tried) == len(best):
                best, high = tried, cap
            else:
                low = cap + 1
        return [(x, y, depth) for x, y in zip(best[:-1], best[1:], strict=True)]

    def _joined(self, pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Small remainders join a neighbour that has room, across the deeper of their two cuts."""
        out = list(pieces)
        i = 0
        while i < len(out):
            a, e, depth = out[i]
            if e - a < SMALL * self.limit and len(out) > 1:
                left = out[i - 1] if i and e - out[i - 1][0] <= self.limit else None
                right = out[i + 1] if i + 1 < len(out) and out[i + 1][1] - a <= self.limit else None
                if right and (not left or right[2] >= depth):
                    out[i : i + 2] = [(a, right[1], depth)]
                    continue
                if left:
                    out[i - 1 : i + 1] = [(left[0], e, left[2])]
                    i -= 1
                    continue
            i += 1
        return out


def _overlap_start(text: str, a: int, before: int, overlap: int) -> int:
    """Where a piece that begins at ``a`` begins with its overlap: at a sentence, else at a word, else at once."""
    low = max(before, a - overlap)
    for pattern in (FINER[0][1], FINER[2][1]):
        for m in pattern.finditer(text, low, a):
            if low < m.start() < a or (m.start() == low and low == before):
                return m.start()
    return low if not any(c.isspace() for c in text[low:a]) else a


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, end, own_start)`` of each piece of a text, trimmed of white space at its ends.

    A piece has at most ``limit`` characters; ``start <= own_start`` and the part between them, at
    most ``overlap`` characters, repeats the end of the piece before. A text within the limit is
    one piece, a blank one none.
    """
    lead = len(text) - len(text.lstrip())
    end = len(text.rstrip())
    if end <= lead:
        return []
    if end - lead <= limit:
        return [(lead, end, lead)]
    out: list[tuple[int, int, int]] = []
    for a, e, _ in Tree(text, limit - overlap).pack(lead, end):
        while a < e and text[a].isspace():
            a += 1
        while e > a and text[e - 1].isspace():
            e -= 1
        if a == e:
            continue
        start = _overlap_start(text, a, out[-1][2], overlap) if out else a
        out.append((start, e, a))
    return out


class Pieces:
    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, overlap

    def __call__(self, batches):
        for batch in batches:
            pages = zip(batch.column("page_start").to_pylist(), batch.column("page_end").to_pylist(), strict=True)
            rows, cols = [], [[] for _ in range(7)]
            for i, (text, (first, last)) in enumerate(zip(batch.column("passage").to_pylist(), pages, strict=True)):
                spans = split_text(text or "", self.limit, self.overlap)
                if len((text or "").strip()) <= self.limit:
                    continue
                n = len(text)
                for k, (a, e, own) in enumerate(spans):
                    rows.append(i)
                    p = [None, None]
                    if first is not None and last is not None:
                        span = max(0, last - first)
                        p = [first + min(span, (a * (span + 1)) // n), first + min(span, ((e - 1) * (span + 1)) // n)]
                    for c, v in zip(cols, (k, text[a:e], a, e, own - a, *p), strict=True):
                        c.append(v)
            at = pa.array(rows, pa.int64())
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(at), batch.column("clause").take(at), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["chunk_id", "clause", "piece", "text", "start_pos", "end_pos", "overlap", "page_start", "page_end"])


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every passage above the limit: ``chunk_id, clause, piece, text, start_pos, end_pos, overlap, page_start, page_end``.

    Positions are code points of the passage. The page range of a piece is the part of the
    passage's pages that its place in the text covers, null if a page is null. Passages within the
    limit after trimming, empty and null ones have no rows. A passage without any boundary is cut
    at the limit. Repeated rows of one chunk_id count once; of different long texts under one chunk_id the
    greatest counts. One scan; only the rows that are split are shuffled, before they are split.
    """
    p = passage(F.col("text").cast("string"))
    held = chunks.select("chunk_id", F.col("clause").cast("string").alias("clause"), F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), p.alias("passage")).where(F.length("passage") > limit)
    once = held.groupBy("chunk_id").agg(F.max(F.struct("passage", "clause", "page_start", "page_end")).alias("x"))
    return once.select("chunk_id", "x.*").mapInArrow(Pieces(limit, overlap), "chunk_id string, clause string, piece int, text string, start_pos bigint, end_pos bigint, overlap int, page_start int, page_end int")

def p5_found(spark, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks")).where("piece = 0").select("chunk_id")


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"))


def rejoined(pieces: DataFrame) -> DataFrame:
    """``chunk_id, md5, n_over, page_start, page_end``: a hash of the pieces put together again without overlaps and white space, and how many exceed a bound."""
    own = F.expr("substring(text, overlap + 1)")
    parts = F.sort_array(F.collect_list(F.struct("piece", own.alias("own"))))  # the pieces of one passage
    whole = F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["own"]), ""), WHITE, "")
    over = (F.length("text") > LIMIT) | (F.col("overlap") > OVERLAP) | (F.col("overlap") < 0) | (F.col("page_start") > F.col("page_end"))
    return pieces.groupBy("chunk_id").agg(F.md5(whole).alias("md5"), F.sum(over.cast("bigint")).alias("n_over"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))


def p5_rejoined(spark, sf_dir: str) -> DataFrame:
    return rejoined(p5_pieces(spark, sf_dir))
