"""Sentence boundaries across languages and scripts (problem 9).

Every text is cut at blank lines into units. In a unit, marks that may end a sentence form a
lattice of edges: a quotation or bracket is one edge that no boundary may cross, and each
terminator is a gap that the words on its two sides open or close. Stretches of scripts without blanks
(Chinese, Japanese, Thai) are segmented whole by the best path through a lattice of dictionary words,
those of a public tokenizer's vocabulary and the particles and opening words below. Their gaps are
classified by the words of the path: a final particle before and an opening word after end a sentence,
with or without a mark; a word of saying or of linking after a mark goes on.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- Fixed values: words that carry a period or open and close sentences.

#: A name, number or explanation follows, so the period never ends a sentence.
NEVER_FINAL = frozenset(
    "dr prof capt mr mrs ms messrs st sr sra srta dra mme mlle mgr rev hon gen col lt sgt maj hr fr frau dipl ing"
    " e.g i.e vs cf approx ca bzw vgl viz ibid al d.h z.b u.a resp ggf z.t p.ex c.-à-d د डॉ श्री".split()
)
#: The period belongs to the word where a number follows.
BEFORE_NUMBER = frozenset("no nos nr art arts cl p pp fig figs vol vols para paras ext s sec ch est núm pág págs cap abs bd kap chap eq ref st ov app".split())
#: Words that may stand at the very end: the next word decides.
MAY_END = frozenset("etc jr ltd co inc corp a.m p.m u.s u.k ph.d usw b.c a.d ov ave rd dept govt plc gmbh ee.uu m.d b.a m.a".split())
#: Months after a German ordinal.
MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split())
#: Words after "Co." that belong to the same company name.
COMPANY = ("Ltd", "Inc", "Corp", "KG", "GmbH")
#: Dictionary for lattices: verbs of saying and words that link to what stands before, by script.
SAYING = ("说", "道", "问", "喊", "表示", "写道", "回答", "説", "問")
LINKING = {"zh": ("也", "但", "而", "却", "并", "就"), "ja": ("と", "って", "という", "との", "とは"), "hi": ("ऐसा", "यह", "कहकर", "ऐसे")}
#: Particles that close a sentence before any opening word, and those that do so only before a strong one or a blank.
FINAL_PARTICLES = ("吗", "呢", "吧", "嗎", "啊", "呀", "嘛", "です", "ます", "でした", "ました", "ません", "ですか", "ますか", "ですね", "ますね", "ですよ", "ますよ", "ครับ", "ค่ะ", "นะคะ", "นะครับ")
WEAK_PARTICLES = ("了", "だ", "だった", "か", "ね", "よ", "ぞ")
#: Words that open a sentence; the weak ones do so only after a particle that is not weak.
OPENING = ("如果", "因为", "因為", "即使", "虽然", "雖然", "但是", "所以", "不过", "然后", "もし", "しかし", "そして", "だから", "それで", "แม้ว่า", "หลังจาก", "ถ้า", "ก่อน", "ขณะที่", "เพราะ", "เมื่อ", "แต่")
WEAK_OPENING = ("我们", "我們", "我", "你们", "你", "他们", "他", "她", "双方", "今天", "明天", "现在", "また", "でも", "私", "彼", "今日", "明日")
#: Words that end in a particle's or a saying verb's letters and are neither.
WHOLE_WORDS = ("酒吧", "网吧", "知道", "街道", "味道", "报道", "報道", "跑道", "难道", "小说", "听说", "传说", "据说", "学问", "疑问", "访问", "提问", "かもしれない", "かもしれません")

#: The public vocabulary that lattices take words from.
LATTICE_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

END = ".!?…。！？؟।॥．｡"
CLOSERS = "\"'”’»)]}」』）】〉》"
OPENERS = "\"'“‘«([{「『（【〈《„¿¡"
BLANK_LINE = re.compile(r"\n\s*\n")
THAI = re.compile(r"[฀-๿]")
THAI_GAP = re.compile(r"\s+")
#: Every branch begins with a literal, which the search runs to: closed quotations and brackets, then runs of marks (no decimal point).
_RUN = r"(?:\.(?:(?!\d)|(?<!\d\.))|[!?…。！？؟।॥．｡])*"
MARKS = re.compile(
    r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）|\"[^\"]*\"|‘(?:[^’]|’(?=\w))*’|"
    + r"\.(?:(?!\d)|(?<!\d\.))" + _RUN + "".join(f"|{re.escape(c)}{_RUN}" for c in "!?…。！？؟।॥．｡")
)
WHOLE = frozenset("“„«「『([（\"‘")
#: Endings of file names; a period before them is part of the name.
FILE_ENDINGS = frozenset("docx pdf xlsx csv txt json xml html htm pptx png jpg jpeg gif mp3 mp4 zip".split())
NO_WORD = frozenset("([{“‘«\"'„¿¡/,;:’”–—")
FIRST_WORD = re.compile(r"\w+")
LIST_MARK = re.compile(r"\s*(?:\(?\d{1,3}|\(?[A-Za-z])$")
CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
STRAY = re.compile(r"(?:[^\w\s!-/:-@\[-`{-~।॥،؛“”‘’«»„…]|[½¼¾²³]|<[^<>]{1,20}>)+(?=\s)")
PLAIN_END = frozenset("!?؟।॥")
CLAUSE_MARK = re.compile("[，、；：,;:]")
#: Words before a period that any other rule may have a say on.
RULED = NEVER_FINAL | BEFORE_NUMBER | MAY_END


class WordLattice:
    """Best path of dictionary words through a text without blanks.

    Each dictionary word costs 1, an unknown character 1.6; the cheapest path wins, longer
    words first among equals.
    """

    def __init__(self, words):
        self.words = frozenset(words)
        self.longest = max(map(len, self.words))

    def segment(self, text: str) -> list[str]:
        n = len(text)
        cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
        for i in range(n):
            for k in range(min(self.longest, n - i), 0, -1):
                known = text[i : i + k] in self.words
                if known or k == 1:
                    c = cost[i] + (1.0 if known else 1.6)
                    if c < cost[i + k]:
                        cost[i + k], back[i + k] = c, i
        out: list[str] = []
        while n:
            out.append(text[back[n] : n])
            n = back[n]
        return out[::-1]


LISTED = (*SAYING, *FINAL_PARTICLES, *WEAK_PARTICLES, *OPENING, *WEAK_OPENING, *WHOLE_WORDS, *(w for x in LINKING.values() for w in x))
#: Tokens of two letters and more of a script without blanks; those of Thai begin and end like words.
SPACELESS = re.compile(r"[぀-ヿ㐀-鿿]{2,}|[เ-ไก-ฮ][฀-๿]+[^เ-ไ]")
SPACELESS_STRETCH = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ฀-๿]+")
_ENDS_IN_PARTICLE = re.compile("(?:" + "|".join(sorted((*FINAL_PARTICLES, *WEAK_PARTICLES, *SAYING), key=len, reverse=True)) + ")$")


def dictionary(path: str = LATTICE_VOCABULARY) -> frozenset[str]:
    """Words of a lattice: those listed here, and the tokens of a public vocabulary that look like words.

    A token that ends in a particle or a verb of saying would hide it, so it is left out.
    """
    out = set(LISTED)
    for line in open(path, "rb"):
        token = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip()
        if SPACELESS.fullmatch(token) and not _ENDS_IN_PARTICLE.search(token):
            out.add(token)
    return frozenset(out)


@lru_cache(maxsize=1)
def _own_lattice() -> WordLattice:
    return WordLattice(dictionary())


_SENT: list[WordLattice] = []


def lattice() -> WordLattice:
    """The lattice that the driver sent to this worker, else that of the usual vocabulary."""
    return _SENT[0] if _SENT else _own_lattice()


_CLOSING = sorted((*FINAL_PARTICLES, *WEAK_PARTICLES), key=len, reverse=True)
_STARTING = sorted((*OPENING, *WEAK_OPENING), key=len, reverse=True)
#: Where a gap may be: what is found is then read off the path.
GAP = re.compile(f"(?:{'|'.join(_CLOSING)})\\s*(?:{'|'.join(_STARTING)})")


def _particle_ends(unit: str) -> list[int]:
    """Gaps without a mark that a final particle closes and an opening word opens, in scripts without blanks."""
    out, words = [], []
    for m in SPACELESS_STRETCH.finditer(unit):
        at = m.start()
        for w in lattice().segment(m.group()):
            words.append((at, at + len(w), w))
            at += len(w)
    for (_, e, w), (a, _, following) in zip(words[:-1], words[1:]):
        blank = a > e
        if blank and unit[e:a].strip():
            continue
        strong, weak = w in FINAL_PARTICLES, w in WEAK_PARTICLES
        opens, may_open = following in OPENING, following in WEAK_OPENING
        if (strong and (opens or may_open)) or (weak and blank and (opens or may_open)) or (w == "了" and opens):
            out.append(e)
    return out


def _opens(unit: str, at: int, n: int) -> int:
    """What stands after a gap: 0 something that continues, 1 a new sentence, 2 caseless or other, 3 a digit."""
    while at < n and (unit[at].isspace() or unit[at] in OPENERS):
        at += 1
    m = STRAY.match(unit, at)
    if m:  # a symbol by itself says nothing, the word after it does
        return _opens(unit, m.end(), n)
    if at >= n:
        return 1
    c = unit[at]
    if c.islower():
        return 1 if at + 1 < n and unit[at + 1].isupper() else 0
    if c.isupper() or c.istitle():
        return 1
    if c.isdigit():
        return 3
    return 0 if c in ",;:)]}、，；：،؛%&=+/–—" else 2


def _stretch(unit: str, at: int) -> str:
    """From a gap to the next end mark, without it."""
    m = MARKS.search(unit, at)
    return unit[at : m.start() if m else len(unit)].strip()


def _whole_ends(unit: str, m: re.Match, n: int) -> int:
    """End of the sentence that a quotation or bracket closes, or -1."""
    a, e = m.span()
    inner = unit[a + 1 : e - 1].rstrip()
    k = e
    while k < n and unit[k] in CLOSERS and unit[k] not in "\"'":
        k += 1
    if not inner or inner[-1] not in END:
        return -1
    if k < n and unit[k] in END:
        return -1  # the mark outside decides
    rest = k
    while rest < n and unit[rest].isspace():
        rest += 1
    if rest >= n:
        return k
    c = unit[rest]
    opened = unit[a]
    if CJK.match(c):
        if opened in "（([":
            return k
        path = lattice().segment(_stretch(unit, rest))
        return -1 if path and (path[0] in LINKING["ja"] or path[-1] in SAYING) else k
    first = FIRST_WORD.match(unit, rest)
    if first and any(unit.startswith(w, rest) for w in LINKING["hi"]):
        return -1
    if "؀" <= c <= "ۿ" or "ऀ" <= c <= "ॿ":
        return k
    return k if _opens(unit, rest, n) else -1


def _word_before(unit: str, at: int) -> str:
    """What stands before a period without a blank, bracket, quote or dash in it."""
    start = at
    while start and unit[start - 1] not in NO_WORD and not unit[start - 1].isspace():
        start -= 1
    return unit[start:at]


def _period(unit: str, at: int, e: int, n: int) -> bool:
    """Whether the single period at ``at`` ends a sentence; ``e`` is past it and its closers."""
    before = _word_before(unit, at)
    tail = before.rpartition(".")[2]
    if tail.casefold() in NEVER_FINAL and len(before) - len(tail) > 3 and before[-len(tail) - 2 : -len(tail) - 1].islower():
        before = tail  # the blank after the sentence before is missing
    key = before.casefold()
    gap = e < n and unit[e].isspace()
    if e >= n or not unit[e:].strip():
        return not (at == n - 1 and LIST_MARK.match(unit[:at]) and len(unit.strip()) < 5)
    if not gap:
        c = unit[e]
        if c in OPENERS:
            return bool(before) and key not in NEVER_FINAL
        if CJK.match(c):
            return bool(before) and not (before[-1].isascii() and key in BEFORE_NUMBER)
        if not c.isalnum():
            return False
        if "@" in before or "_" in before or before.startswith(("www.", "http")):
            return False
        if FIRST_WORD.match(unit, e).group().casefold() in FILE_ENDINGS:
            return False
        if key in ("a.m", "p.m", "ltd", "inc", "etc", "jr") and c.isupper() and e + 1 < n and unit[e + 1].islower():
            return True
        if len(before) < 2 or key in NEVER_FINAL or key in MAY_END or key in BEFORE_NUMBER or "." in before.strip("0123456789."):
            return False
        if c.isupper():
            return (e + 1 < n and (unit[e + 1].islower() or unit[e + 1].isspace())) and (before[-1].islower() or before[-1].isdigit())
        if c.isdigit():
            return len(before) > 2 and before.isalpha() and before.islower()
        if c.islower():  # a name such as iScore
            return e + 1 < n and unit[e + 1].isupper()
        return not c.isascii()
    opens = _opens(unit, e, n)
    if not opens:
        return False
    if not before:
        return True
    if key in NEVER_FINAL and not (key in ("sr", "al") and opens == 1 and before == "al"):
        return False
    rest = e
    while unit[rest].isspace():
        rest += 1
    if key in MAY_END:
        return not (opens == 3 and key in ("u.s", "u.k", "ee.uu") or key == "co" and unit.startswith(COMPANY, rest))
    if key in BEFORE_NUMBER:
        if opens == 3:
            return False
        follow = FIRST_WORD.match(unit, rest)
        return not (follow and re.fullmatch(r"[IVXLC]+", follow.group())) and len(before) > 1
    if len(before) == 1 and before.isalpha() and before.isascii():
        if before.isupper() or re.match(r"[A-Za-z]\.", unit[rest : rest + 2]):
            return False  # an initial, or one of an abbreviation's letters
    if before.isdigit():
        if LIST_MARK.match(unit, 0, at) and not unit[:at].strip(" \t\r\n(").strip(before):
            return False  # a list mark
        follow = FIRST_WORD.match(unit, rest)
        if follow and follow.group() in MONTHS and len(before) < 3:
            return False
    return True


def _unit_ends(unit: str) -> list[int]:
    """Ends of the sentences of one unit, without the last."""
    n, ends = len(unit), []
    for m in MARKS.finditer(unit):
        a, e = m.span()
        if unit[a] in WHOLE:
            e = _whole_ends(unit, m, n)
            if e >= 0:
                ends.append(e)
            continue
        marks = unit[a:e]
        if marks == "." and e + 1 < n and unit[e] == " " and unit[e + 1].isupper():
            word = unit[unit.rfind(" ", 0, a) + 1 : a]
            if len(word) > 1 and word.isalpha() and word.islower() and word not in RULED:
                ends.append(e)  # what _period says of such a word, at once
                continue
        while e < n and unit[e] in CLOSERS and not (unit[e] in "\"'" and e + 1 < n and not unit[e + 1].isspace()):
            e += 1
        if marks == ".":
            if _period(unit, a, e, n):
                ends.append(e)
            continue
        rest = e
        while rest < n and unit[rest].isspace():
            rest += 1
        if rest >= n:
            ends.append(n if e >= n else e)
            continue
        if marks[-1] in "。！？．｡" or (marks[-1] in "!?" and CJK.match(unit[rest])):
            if unit[rest] not in "，、；：,":
                ends.append(e)
            continue
        if "…" in marks or marks.startswith(".."):
            if marks[-1] in "!?":
                if _opens(unit, e, n):
                    ends.append(e)
            elif CJK.match(unit[rest]):
                path = lattice().segment(CLAUSE_MARK.split(_stretch(unit, rest))[0])
                if not any(w in LINKING["zh"] for w in path):
                    ends.append(e)
            elif _opens(unit, e, n) in (1, 2, 3) and not (a and unit[a - 1].isspace() and _opens(unit, e, n) == 3):
                ends.append(e)
            continue
        if marks[0] in PLAIN_END and _opens(unit, e, n) or marks[0] == "." and _opens(unit, e, n):
            ends.append(e)
    return ends


def _thai_ends(unit: str) -> list[int]:
    """White space in Thai that touches no digit."""
    out = []
    for m in THAI_GAP.finditer(unit):
        a, e = m.span()
        if a and e < len(unit) and not unit[a - 1].isdigit() and not unit[e].isdigit() and (THAI.match(unit[a - 1]) or THAI.match(unit[e])):
            out.append(a)
    return out


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """``(start, end)`` of every sentence, in code points, white space around it left out."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    begin = 0
    breaks = [m.span() for m in BLANK_LINE.finditer(text)]
    breaks.append((len(text), len(text)))
    for stop, after in breaks:
        unit = text[begin:stop]
        ends = _unit_ends(unit)
        if THAI.search(unit):
            ends = sorted({*ends, *_thai_ends(unit)})
        if GAP.search(unit):
            ends = sorted({*ends, *_particle_ends(unit)})
        at = 0
        for e in (*ends, len(unit)):
            if e <= at:
                continue
            piece = unit[at:e]
            core = piece.strip()
            if core:
                s = begin + at + len(piece) - len(piece.lstrip())
                out.append((s, s + len(core)))
            at = e
        begin = after
    return out


class Split:
    def __init__(self, words):
        self.words = words

    def __call__(self, batches):
        _SENT[:] = [WordLattice(self.words.value)]
        for batch in batches:
            counts, spans = [], []
            for text in batch.column(1).to_pylist():
                found = sentence_spans(text)
                counts.append(len(found))
                spans.extend(found)
            owner = np.repeat(np.arange(len(counts)), counts)
            pos = np.array(spans, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(pos[:, 0]), pa.array(pos[:, 1])], names=["key", "start_pos", "end_pos"])


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = LATTICE_VOCABULARY) -> DataFrame:
    """``key, start_pos, end_pos``, one row per sentence of each row's text.

    One scan, no shuffle. Null, empty and blank texts have no row; a text without any end mark
    is one sentence per unit; repeated rows and null keys give their own rows; other columns are
    not read, whatever their names. The words of lattices are read from ``vocabulary`` on the driver
    and broadcast: a fixed few hundred.
    """
    words = df.sparkSession.sparkContext.broadcast(dictionary(vocabulary))
    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(Split(words), f"key {kind}, start_pos bigint, end_pos bigint")
    return out.withColumnRenamed("key", key)
