"""Broken prompt and response pairs (problem 1).

A linear classifier with one output per defect reads hashed n-grams of the passage, hashed
n-grams of its tail, and features of the pair. It is trained on the driver on a bounded sample
of pairs and on defects made from it: truncated, copied, swapped (another language), refused
and emptied passages. Thresholds and slopes are calibrated on a held-out part. Every pair of the table is
then scored; the outputs alone decide.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.functions.codepoints import blocks, codepoints, mix64, segment_hashes, words
from rulemill.functions.language import WORD_BASE, main_languages
from rulemill.functions.texts import passage
from rulemill.session import table

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
#: Labelled pairs that the classifier is fitted on, at most.
SAMPLE_PAIRS = 2_000
BITS = 17
SEED = 7
ROUNDS = 60
#: Rounds of the first fit, which only finds defects in the sample.
FIRST_ROUNDS = 25
DECAY = 1e-5

# -- Fixed values for made defects.
STAND_INS = ("", " ", "-", "--", "---", "...", "…", "?", "*", "n/a", "N/A", "N/A.", "na", "none", "None", "null", "NULL", "nil", "nan", "TBD", "TBA", "tbc", "to be confirmed", "to follow", "[blank]", "(blank)", "(empty)", "[no text]", "no text", "no content", "not available", "missing", "unknown", "undefined", "pending", "x", "\n\n", "\t", "​", " ", "[removed]", "(none)", "void", "no data", "<empty>", "#N/A")
REFUSE = ("I cannot answer this question", "I can't answer that", "I am unable to respond to this", "I'm sorry, but I can't help with that", "Sorry, I cannot provide this", "I am not able to give this information", "I must decline to answer", "I won't be able to assist with this request", "As an assistant I cannot state this", "As an AI language model, I am unable to comment on this", "That is not something I can discuss", "No answer can be given here", "I have no basis to reply", "The text gives me no basis for an answer", "Unfortunately I cannot provide a response", "I'd rather not comment on that", "I do not have enough information to answer", "I refuse to answer this", "It would not be appropriate for me to reply", "It would be inappropriate for me to answer that", "My guidelines do not let me answer", "My instructions prevent me from responding", "My policy does not allow me to comment", "Answering that is beyond what I am allowed to do", "This is outside what I can respond to", "We are not in a position to answer this question", "I prefer not to say", "I would rather leave that to an expert", "Such a request has to be declined", "Je ne peux pas répondre à cette question", "Ich kann diese Frage leider nicht beantworten", "No puedo responder a esta pregunta", "Es tut mir leid, dazu kann ich nichts sagen", "Lo siento, no puedo ayudar con eso", "Je suis désolé, je ne peux pas vous aider")
BECAUSE = ("", "", " for safety reasons", " without more context", " as it lies outside my scope", " because no source was supplied", "; please ask a qualified official", " and suggest you contact the board", " given the limits set for me", " as I only handle other subjects", " since it may touch on private matters", " at this time")
AROUND = (("", ""), ("", " Try another question!"), ("Thank you for the question. ", ""), ("Thanks for asking. ", ""), ("Re: ", ""), ("Regarding the matter: ", ""), ("", " You may wish to read the official edition."), ("Hello. ", " Have a nice day."), ("", " Is there anything else I can help with?"), ("", " The office keeps a list of contacts."), ("", " Please consult the official rules."))
LEAD_IN = ("", "", "", "Question: ", "Q: ", "You asked: “", "The question was: ", "You want to know: ", "Re: ", "Regarding your question: ")
CUT_TAILS = ("", "", "", "", "", ",", " -", " ...", "…", " and the", ' as "the', " as follows:", "\n(b)", " (see", " (see cl.", " i.e.", " e.g.", ", cf.", " of the", ";")
FOREIGN = {
    "fr": "Le capitaine doit signaler la décision avant la pause. L'arbitre fait retirer les bâches après la pluie, et le match reprend sans autre délai. Les joueurs sont sur le terrain pendant que le public attend dans les tribunes.",
    "es": "El capitán debe comunicar la decisión antes de la pausa. El árbitro manda retirar las lonas después de la lluvia y el partido sigue sin más demora. Los jugadores están en el campo mientras el público espera.",
    "de": "Der Kapitän muss die Entscheidung vor der Pause melden. Der Schiedsrichter lässt die Abdeckung nach dem Regen entfernen, und das Spiel wird ohne weitere Verzögerung fortgesetzt, während die Zuschauer auf den Rängen warten.",
    "ar": "يجب على القائد أن يبلغ عن القرار قبل الاستراحة. يأمر الحكم برفع الأغطية بعد المطر ثم تستأنف المباراة دون تأخير بينما ينتظر الجمهور في المدرجات.",
    "hi": "कप्तान को विराम से पहले निर्णय की सूचना देनी होगी। बारिश के बाद अंपायर आवरण हटवाएगा और खेल बिना देरी के फिर शुरू होगा, जबकि दर्शक प्रतीक्षा करेंगे।",
    "zh": "队长必须在休息前报告决定。雨停之后裁判命令撤去雨布，比赛立即恢复，观众在看台上等候。",
    "ja": "主将は休憩の前に決定を報告しなければならない。雨の後、審判はカバーを外させ、観客が待つ間に試合はすぐに再開する。",
    "th": "กัปตันต้องรายงานการตัดสินก่อนพัก หลังฝนหยุดกรรมการสั่งให้เก็บผ้าคลุม และการแข่งขันเริ่มใหม่ทันทีขณะที่ผู้ชมรออยู่",
    "en": "The captain must report the decision before the interval. After the rain the umpire shall have the covers removed, and play is resumed without further delay while the spectators are waiting in the stands.",
}
#: Parts of the PLAIN_PAIRS plain sound pairs that join every sample.
WHO = ("the captain", "the umpire", "a fielder", "the scorer", "the host board", "each team", "the runner", "the reserve official")
DOES = ("report the decision", "ask for a review", "leave the field", "sign the log", "return to the crease", "wait behind the line", "call the over", "inspect the ground")
WHEN = ("before the interval", "after the over is called", "when both captains agree", "if the light fades", "once play is resumed", "at the end of the session", "in front of the players", "during the same over")
PLAIN_PAIRS = 300
FINAL = ".!?。！？؟।॥"
CLOSERS = "\"'”’»)]}」』）】*_"
SENTENCE_END = re.compile(r"[.!?。！？।؟][\"”’)\]]*(?=\s|$)")
THAI = re.compile(r"[฀-๿]")
#: Thai that cannot end: a vowel written before its consonant, a conjunction or a preposition.
THAI_OPEN = re.compile(r"(?:[เแโใไ]|และ|หรือ|ของ|ที่|ใน|กับ|เพื่อ|โดย|จาก|ซึ่ง|ว่า|ต้อง|จะ|ให้|ถ้า|เมื่อ|ก่อน|หลัง|ระหว่าง|ไม่)\s*$")
#: Thai conjunctions and prepositions after which a made text breaks off.
THAI_JOINS = ("ก่อน", "หลัง", "ต้อง", "ให้", "และ", "ที่")
#: Words without any that points to a known language from which a text counts as foreign to all of them.
FOREIGN_WORDS = 12
#: Abbreviations after which a text cannot stop.
OPEN_ABBREVIATIONS = frozenset("i.e. e.g. cf. cl. no. nos. art. para. fig. vs. viz. approx. ca. vol. pp. p. mr. mrs. dr. prof. st. z.b. bzw. d.h. sec. ch. incl. excl. resp.".split())
MARK_ONLY = re.compile(r"^\(?[A-Za-z0-9]{1,3}[.)]$|^[-•*–]$")
SHAPE = ((re.compile(r"\d+"), "9"), (re.compile(r"[A-Z]{2,}"), "AA"), (re.compile(r"[a-z]{3,}"), "a"), (re.compile(r"\s+"), " "))
#: Dense features of a pair, in order.
DENSE = ("bias", "no_words", "few_words", "short", "log_words", "final_mark", "ellipsis", "open_mark", "own_line", "short_line", "mark_only", "unbalanced", "thai_end", "digit_end", "covered", "covering", "longer", "same_language", "other_language", "unknown_language", "has_question", "open_abbreviation", "symbol_end", "word_end", "stand_in", "only_question", "most_covered", "foreign_words", "thai_cut", "few_said")
#: Weight of the dense features against the hashed ones.
DENSE_SCALE = 1.0
AT = {name: i for i, name in enumerate(DENSE)}


def _bucket(text: str) -> int:
    return zlib.crc32(text.encode()) & ((1 << BITS) - 1)


def tail_features(text: str) -> tuple[list[int], dict[str, float]]:
    """Hashed n-grams and flags of how a passage ends."""
    s = text.rstrip(" \t\r\n 　​")
    flags: dict[str, float] = {}
    if not s:
        return [], flags
    line = s.rsplit("\n", 1)[-1]
    core = s.rstrip(CLOSERS + " ")
    while core and unicodedata.category(core[-1]) in ("So", "Sk", "Mn", "Cf"):  # an emoji or ornament after the end
        core = core[:-1].rstrip(CLOSERS + " ")
    last = core[-1:] or s[-1]
    dots = core.endswith(("...", "…"))
    if core.rsplit(None, 1)[-1:] and core.split()[-1].lower().lstrip("([“\"") in OPEN_ABBREVIATIONS:
        flags["open_abbreviation"] = 1
    elif dots:
        flags["ellipsis"] = 1
    elif last in FINAL:
        flags["final_mark"] = 1
    elif s[-1] in ",:;-–(“„":
        flags["open_mark"] = 1
    elif last.isdigit():
        flags["digit_end"] = 1
    elif not last.isalnum() and not s[-1] in CLOSERS:
        flags["symbol_end"] = 1
    elif last.isalpha() and s[-1] == last and not THAI.match(last):
        flags["word_end"] = 1
    if THAI.match(last):
        flags["thai_end"] = 1
    own = False
    if len(line) < len(s):
        before = s[: -len(line)].rstrip().rstrip(CLOSERS)
        own = before[-1:] in FINAL and bool(before)
        if own:
            flags["own_line"] = 1
            if len(line) <= 60:
                flags["short_line"] = 1
    if MARK_ONLY.match(line.strip()):
        flags["mark_only"] = 1
    if s.count('"') % 2 or s.count("“") != s.count("”") or s.count("(") > s.count(")"):
        flags["unbalanced"] = 1
    tokens = line.split()
    shape = line[-24:]
    for pattern, to in SHAPE:
        shape = pattern.sub(to, shape)
    low = [t.lower() for t in tokens[-3:]]
    grams = ["1" + low[-1], "2" + " ".join(low[-2:]), "3" + shape[-3:], "4" + shape[-7:]] if low else []
    if own and tokens:
        grams += ["5" + tokens[0].lower(), "6" + SHAPE[0][0].sub("9", " ".join(tokens[:2]).lower())]
        whole = line.strip()[:80]
        for pattern, to in SHAPE:
            whole = pattern.sub(to, whole)
        grams.append("8" + whole)
    if not flags.get("final_mark") and tokens:
        grams.append("7" + ("own" if own else "in") + str(min(len(tokens), 8)))
    return [_bucket(g) for g in grams], flags


@dataclass
class Features:
    dense: np.ndarray  # rows x len(DENSE)
    row: np.ndarray  # of each hashed feature
    col: np.ndarray
    value: np.ndarray


def features(questions: pa.Array, passages: pa.Array) -> Features:
    """Features of question and passage pairs; null texts count as empty."""
    q, p = pc.fill_null(questions, ""), pc.fill_null(passages, "")
    n = len(p)
    pf, po = codepoints(p)
    folded, ps, pe, pw = words(pf, po)
    ph = segment_hashes(folded, ps, pe, WORD_BASE)
    qf, qo = codepoints(q)
    qfold, qs, qe, qw = words(qf, qo)
    qh = segment_hashes(qfold, qs, qe, WORD_BASE)
    np_, nq = np.diff(pw), np.diff(qw)
    owner = np.repeat(np.arange(n), np_)
    mask = np.uint64((1 << BITS) - 1)
    pair = np.zeros(len(ph), dtype=bool)
    if len(ph):
        pair[:-1] = owner[:-1] == owner[1:]
    two = mix64(ph[pair] * np.uint64(3) + ph[np.flatnonzero(pair) + 1]) & mask
    grams = 2 * np_ - 1
    scale = 1 / np.sqrt(np.maximum(grams, 1))
    row = np.concatenate([owner, owner[pair]])
    col = np.concatenate([ph & mask, two]).astype(np.int64)
    dense = np.zeros((n, len(DENSE)), dtype=np.float32)
    texts = p.to_pylist()
    tail_row, tail_col = [], []
    for i, t in enumerate(texts):
        cols, flags = tail_features(t)
        tail_row += [i] * len(cols)
        tail_col += cols
        for k, v in flags.items():
            dense[i, AT[k]] = v
    value = np.concatenate([scale[row], np.full(len(tail_col), 1.5)])
    row, col = np.concatenate([row, np.array(tail_row, dtype=np.int64)]), np.concatenate([col, np.array(tail_col, dtype=np.int64)])
    # words in common
    asker = np.repeat(np.arange(n), nq)
    common = told = np.zeros(n)
    key = np.concatenate([mix64(owner.astype(np.uint64)) ^ ph, mix64(asker.astype(np.uint64)) ^ qh])
    if len(key):
        uniq, inv = np.unique(key, return_inverse=True)
        k = len(ph)
        in_p, in_q = np.bincount(inv[:k], minlength=len(uniq)), np.bincount(inv[k:], minlength=len(uniq))
        who = np.zeros(len(uniq), dtype=np.int64)
        who[inv[:k]] = owner
        who[inv[k:]] = asker
        common = np.bincount(who, weights=np.minimum(in_p, in_q), minlength=n)
        told = np.bincount(who, weights=in_p * (in_q > 0), minlength=n)
    # all that the passage says, however often, is in the question; and how much of the question it says
    covered, covering = told / np.maximum(np_, 1), common / np.maximum(nq, 1)
    # a passage that only says the question has the length of saying it once
    once = np.where(covered >= 0.75, np_ * common / np.maximum(told, 1), np_)
    lp = main_languages(pf, po, ph, pw)
    lq = main_languages(qf, qo, qh, qw)
    lengths = np.diff(po)
    dense[:, AT["bias"]] = 1
    dense[:, AT["no_words"]] = np_ == 0
    dense[:, AT["few_words"]] = (np_ <= 4) & (lengths < 60)
    # a stretch without blanks is as many words as its length amounts to
    said = np.where(covered >= 0.75, once, np.maximum(once, lengths / 6))
    dense[:, AT["short"]] = said <= 45
    dense[:, AT["log_words"]] = np.log1p(said) / 5
    dense[:, AT["covered"]] = np.where(covered > 0.5, covered, 0)
    dense[:, AT["covering"]] = covering * (covered > 0.5)
    dense[:, AT["longer"]] = np.clip((once - nq) / 60, -1, 2)
    known = (lp > 0) & (lq > 0)
    dense[:, AT["same_language"]] = known & (lp == lq)
    dense[:, AT["other_language"]] = known & (lp != lq)
    dense[:, AT["unknown_language"]] = ~known
    dense[:, AT["has_question"]] = nq > 0
    final = dense[:, AT["final_mark"]] > 0
    dense[:, AT["stand_in"]] = (np_ == 0) | ((np_ <= 4) & (lengths < 40) & ~((np_ > 2) & final))
    dense[:, AT["only_question"]] = covered >= 0.75
    dense[:, AT["most_covered"]] = np.clip(covered - 0.75, 0, 0.25) * 4 * np.clip(covering, 0, 1)
    dense[:, AT["foreign_words"]] = (lp == 0) & (lq > 0) & (np_ >= FOREIGN_WORDS)
    dense[:, AT["few_said"]] = said <= 12
    # Thai has no marks: a text breaks off where its last stretch is short of the others or its last letter needs another
    for i in np.flatnonzero(dense[:, AT["thai_end"]]):
        dense[i, AT["thai_cut"]] = THAI_OPEN.search(texts[i][-40:]) is not None
    return Features(dense * np.float32(DENSE_SCALE), row, col, value)


@dataclass
class PairModel:
    """Weights of one linear output per defect, its threshold, and the slope that makes outputs comparable."""

    hashed: np.ndarray  # 2**BITS x defects
    dense: np.ndarray  # len(DENSE) x defects
    threshold: np.ndarray
    slope: np.ndarray

    def scores(self, f: Features) -> np.ndarray:
        out = f.dense @ self.dense
        for k in range(len(DEFECTS)):
            out[:, k] += np.bincount(f.row, weights=f.value * self.hashed[f.col, k], minlength=len(out))
        return out

    def margins(self, f: Features) -> np.ndarray:
        """Calibrated log odds of every defect; a pair has each defect whose margin is above 0."""
        return (self.scores(f) - self.threshold) * self.slope

    def decide(self, f: Features) -> np.ndarray:
        """Index of each pair's likeliest defect, -1 for a sound one."""
        above = self.margins(f)
        best = above.argmax(axis=1)
        return np.where(above[np.arange(len(best)), best] > 0, best, -1)


def _cut_inside(text: str, rng: np.random.Generator) -> str | None:
    """A passage broken off inside a sentence, between or within words."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    for _ in range(8):
        at = int(rng.integers(min(30, len(text) - 1), len(text))) if len(text) > 40 else 0
        if at and all(not e - 6 <= at <= e + 12 for e in ends):
            piece = text[:at]
            if rng.random() < 0.6:
                piece = piece.rsplit(" ", 1)[0]
            piece = piece.rstrip(" .!?\n")
            if piece:
                return piece + str(rng.choice(CUT_TAILS))
    return None


def _copied(q: str, rng: np.random.Generator) -> str:
    w = q.split()
    kind = rng.integers(6)
    if kind == 1 and len(w) > 8:
        for _ in range(int(rng.integers(1, 3))):
            w[int(rng.integers(len(w)))] = "this"
    elif kind == 2 and len(w) > 8:
        del w[int(rng.integers(len(w)))]
    elif kind == 3:
        w = w[: max(5, int(len(w) * 0.9))]
    out = " ".join(w)
    if kind == 4:
        out = out.rstrip("?") + "."
    if kind == 5:
        out = out.lower()
    if rng.random() < 0.15:  # the question again and again
        out = " ".join([out] * int(rng.integers(2, 7)))
    lead = str(rng.choice(LEAD_IN))
    return lead + out + ("”" if lead.endswith("“") else "")


def _languages(texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(0, dtype=np.int64)
    flat, offsets = codepoints(pa.array(texts, pa.string()))
    folded, starts, ends, first = words(flat, offsets)
    return main_languages(flat, offsets, segment_hashes(folded, starts, ends, WORD_BASE), first)


def _unknown(text: str, rng: np.random.Generator) -> str:
    """The text in a made language: every letter stands for another of its kind."""
    kinds = ("aeiou", "bcdfghjklmnpqrstvwxz")
    table = {}
    for letters in kinds:
        turned = list(letters)
        rng.shuffle(turned)
        table.update({ord(a): b for a, b in zip(letters, turned, strict=True)} | {ord(a.upper()): b.upper() for a, b in zip(letters, turned, strict=True)})
    return text.translate(table)


def _part(text: str, rng: np.random.Generator) -> str:
    """Some whole sentences of a text."""
    ends = [m.end() for m in re.finditer(r"[.。।]", text)] or [len(text)]
    return text[: ends[int(rng.integers(len(ends)))]]


def made_pairs(sample: list[tuple[str, str]], rng: np.random.Generator) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Questions, passages, labels (rows x defects) and sample number of the sample and of defects made from it."""
    out: list[tuple[str, str, int]] = []
    number: list[int] = []
    good = [(q, p) for q, p in sample if p.strip()]
    tongue = _languages([p for _, p in good])
    usual = np.bincount(tongue, minlength=1).argmax() if len(good) else 0
    foreign = [p for (_, p), k in zip(good, tongue, strict=True) if k not in (0, usual)]
    native = [q for (q, _), k in zip(good, tongue, strict=True) if k == usual]
    for i, (q, p) in enumerate(good):
        number += [i - 1] * (len(out) - len(number))
        out.append((q, p, -1))
        r = rng.random()
        if r < 0.12:
            out.append((q, f"{q} {p}", -1))
        elif r < 0.2:
            other = str(rng.choice(list(FOREIGN)))
            phrase = FOREIGN[other][:40]
            out.append((q, f"{p} “{phrase}.”", -1))
        elif r < 0.4:  # a short but whole passage
            ends = [m.end() for m in SENTENCE_END.finditer(p)]
            if ends:
                out.append((q, p[: ends[min(len(ends) - 1, int(rng.integers(3)))]], -1))
        elif r < 0.5:  # the passage of another question is no defect in itself
            out.append((q, good[int(rng.integers(len(good)))][1], -1))
        if rng.random() < 0.1:  # a whole passage may end in a list of short items, or an ornament
            word = str(rng.choice(("Form", "Table", "Annex", "Item", "Plate")))
            tail = "".join(f"\n- {word} {n}" for n in rng.integers(1, 99, int(rng.integers(1, 5)))) if rng.random() < 0.8 else " ✓"
            if p.rstrip()[-1:] in FINAL:
                out.append((q, p.rstrip() + tail, -1))
        cut = _cut_inside(p, rng)
        if cut:
            out.append((q, cut, 1))
        if q.strip() and rng.random() < 0.6:
            out.append((q, _copied(q, rng), 3))
        if rng.random() < 0.3:
            out.append((q, str(rng.choice(STAND_INS)), 0))
        if rng.random() < 0.5:
            before, after = AROUND[int(rng.integers(len(AROUND)))]
            because = str(rng.choice(BECAUSE))
            if rng.random() < 0.35:  # no more than the refusal
                before = after = because = ""
            text = before + str(rng.choice(REFUSE)) + because + ("." if after or rng.random() < 0.75 else "") + after
            out.append((q, text.upper() if rng.random() < 0.12 else text.replace("'", "’") if rng.random() < 0.3 else text, 2))
        if rng.random() < 0.1:  # broken off Thai, and whole Thai
            thai = FOREIGN["th"]
            asked = _part(FOREIGN["th"], rng)
            out.append((asked, thai, -1))
            stops = [m.start() for m in re.finditer("|".join(THAI_JOINS), thai)]
            at = stops[int(rng.integers(len(stops)))]
            out.append((asked, thai[: at + len(next(w for w in THAI_JOINS if thai.startswith(w, at)))], 1))
        if rng.random() < 0.08:  # without a question no language is another; letters and digits at random are no refusal
            out.append(("", FOREIGN[str(rng.choice(list(FOREIGN)))], -1))
            out.append((q, "".join(rng.choice(list("abcdefghjk0123456789012345678901234567890"), int(rng.integers(60, 1500)))) + ".", -1))
        if rng.random() < 0.1 and tongue[i] == usual:  # a language that none of the lists knows
            out.append((q, _unknown(p, rng), 4))
        if rng.random() < 0.08:  # a refusal that goes on and on
            more = " ".join(str(x) + str(rng.choice(BECAUSE)) + "." for x in rng.choice(REFUSE[:29], int(rng.integers(4, 12))))
            out.append((q, more, 2))
        r = rng.random()
        if r < 0.6:  # swapped: a passage in another language than the question, or both in that language
            x, y = (str(v) for v in rng.choice(list(FOREIGN), 2, replace=False))
            text, asked = _part(FOREIGN[x], rng), _part(FOREIGN[y if r < 0.15 else x], rng)
            out.append((asked, text, 4 if r < 0.15 else -1) if r < 0.3 else (q, text, 4 if x != "en" and tongue[i] == usual else -1))
        elif r < 0.75 and foreign and native:
            lead = str(rng.choice(("", "", "Re: ", "Answer: ", "Note. ", "Reply. ")))
            out.append((native[int(rng.integers(len(native)))], lead + foreign[int(rng.integers(len(foreign)))], 4))
    y = np.zeros((len(out), len(DEFECTS)), dtype=np.float32)
    for i, (_, _, k) in enumerate(out):
        if k >= 0:
            y[i, k] = 1
    number += [len(good) - 1] * (len(out) - len(number))
    return [o[0] for o in out], [o[1] for o in out], y, np.array(number)


def _fit(f: Features, y: np.ndarray, use: np.ndarray, rounds: int) -> PairModel:
    """Logistic regression by Adam over the rows in ``use``, with weight decay on the hashed n-grams."""
    shape = (1 << BITS, len(DEFECTS))
    hashed, dense = np.zeros(shape, dtype=np.float32), np.zeros((len(DENSE), len(DEFECTS)))
    mh, vh, md, vd = np.zeros(shape, dtype=np.float32), np.zeros(shape, dtype=np.float32), np.zeros_like(dense), np.zeros_like(dense)
    keep = use[f.row]
    row, col, value = f.row[keep], f.col[keep], f.value[keep]
    for step in range(1, rounds + 1):
        s = f.dense @ dense
        for k in range(len(DEFECTS)):
            s[:, k] += np.bincount(row, weights=value * hashed[col, k], minlength=len(s))
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * use[:, None] / use.sum()
        warm1, warm2 = 1 - 0.9**step, 1 - 0.99**step
        d = f.dense.T @ g
        md, vd = 0.9 * md + 0.1 * d, 0.99 * vd + 0.01 * d * d
        dense -= 0.25 * (md / warm1) / (np.sqrt(vd / warm2) + 1e-7)
        for k in range(len(DEFECTS)):
            h = np.bincount(col, weights=value * g[row, k], minlength=1 << BITS) + DECAY * hashed[:, k]
            mh[:, k] = 0.9 * mh[:, k] + 0.1 * h
            vh[:, k] = 0.99 * vh[:, k] + 0.01 * h * h
            hashed[:, k] -= 0.02 * (mh[:, k] / warm1) / (np.sqrt(vh[:, k] / warm2) + 1e-5)
    return PairModel(hashed, dense, np.zeros(len(DEFECTS)), np.ones(len(DEFECTS)))


def _slope(own: np.ndarray, truth: np.ndarray) -> float:
    """Slope of the log odds over the distance from the threshold, by Newton's steps with a weak prior."""
    slope = 1.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(slope * own, -30, 30)))
        g = ((truth - p) * own).sum() - 0.1 * (slope - 1)
        slope = float(np.clip(slope + g / ((p * (1 - p) * own * own).sum() + 0.1), 0.2, 5))
    return slope


def plain_pairs(n: int, rng: np.random.Generator) -> list[tuple[str, str]]:
    """Sound pairs of plain sentences."""
    pick = lambda x: str(rng.choice(x))

    def sentence() -> str:
        text = f"{pick(WHO)} {pick(('may', 'shall', 'must'))} {pick(DOES)} {pick(WHEN)}"
        return text[0].upper() + text[1:] + "."

    return [(f"{pick(('May', 'Must', 'Shall'))} {pick(WHO)} {pick(DOES)} {pick(WHEN)}?", " ".join(sentence() for _ in range(int(rng.integers(2, 8))))) for _ in range(n)]


def train(sample: list[tuple[str | None, str | None]], seed: int = SEED) -> PairModel:
    """Fit and calibrate on pairs taken as sound and defects made from them.

    Every sample is joined by plain pairs. Pairs of the sample that a first model calls defective are dropped before the second fit, as
    the sample itself holds defects.
    """
    pairs = [(q or "", p or "") for q, p in sample] + plain_pairs(PLAIN_PAIRS, np.random.default_rng(seed))
    told = features(pa.array([q for q, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string())).dense
    odd = told[:, [AT["stand_in"], AT["only_question"], AT["other_language"]]].any(axis=1)  # not taken as sound
    pairs = [x for x, o in zip(pairs, odd, strict=True) if not o] or pairs
    model = None
    for rounds in (FIRST_ROUNDS, ROUNDS):
        rng = np.random.default_rng(seed)
        kept = pairs
        if model is not None:
            found = model.decide(features(pa.array([q for q, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string())))
            kept = [x for x, k in zip(pairs, found, strict=True) if k < 0] or pairs
        q, p, y, number = made_pairs(kept, rng)
        f = features(pa.array(q, pa.string()), pa.array(p, pa.string()))
        held = number % 4 == 0  # held out with everything made from the same pair
        model = _fit(f, y, ~held, rounds)
        s = model.scores(f)
        for k in range(len(DEFECTS)):  # of the thresholds of the best F1 on the held-out part one below the middle, as made defects are plainer than real ones
            own, truth = s[held, k], y[held, k] > 0
            grid = np.linspace(-3, 3, 61)
            hit = own[None, :] > grid[:, None]
            f1 = 2 * (hit & truth).sum(1) / np.maximum(1, hit.sum(1) + truth.sum())
            model.threshold[k] = np.quantile(grid[f1 >= f1.max() - 1e-9], 0.4)
            model.slope[k] = _slope(own - model.threshold[k], truth)
    return model


class Score:
    def __init__(self, shared, every: bool):
        self.shared, self.every = shared, every

    def __call__(self, batches):
        for batch in batches:
            found = [np.zeros((0, len(DEFECTS)))]
            for a, b in blocks(batch.column(2)):
                found.append(self.shared.value.margins(features(batch.column(1)[a:b], batch.column(2)[a:b])))
            above = np.concatenate(found)
            if not self.every:
                above[above < above.max(axis=1, keepdims=True)] = -1
            row, k = np.nonzero(above > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([DEFECTS[i] for i in k], pa.string()), pa.array(1 / (1 + np.exp(-above[row, k])))], names=["qid", "defect", "probability"])


def paired(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``qid, question, passage`` of every question whose passage exists; a hot passage is split by AQE's skew join."""
    asked = questions.select("qid", F.col("question").cast("string"), "pos_chunk_id").where("qid is not null and pos_chunk_id is not null")
    held = chunks.select(F.col("chunk_id").alias("pos_chunk_id"), passage(F.col("text")).alias("passage")).where("pos_chunk_id is not null")
    return asked.join(held, "pos_chunk_id").select("qid", "question", "passage")


def sample_pairs(questions: DataFrame, chunks: DataFrame, size: int = SAMPLE_PAIRS, seed: int = SEED) -> list[tuple[str | None, str | None]]:
    """At most ``size`` pairs, the first in the order of a seeded hash; this bound is the only limit on the fit."""
    first = questions.where("qid is not null and pos_chunk_id is not null").select("qid", "question", "pos_chunk_id").orderBy(F.xxhash64(F.col("qid"), F.lit(seed)), "qid").limit(size)
    rows = paired(first, chunks.join(F.broadcast(first.select(F.col("pos_chunk_id").alias("chunk_id")).distinct()), "chunk_id", "left_semi")).collect()  # bounded by size
    once = {r["qid"]: (r["question"], r["passage"]) for r in rows}
    return [once[k] for k in sorted(once)]


def defective_pairs(questions: DataFrame, chunks: DataFrame, size: int = SAMPLE_PAIRS, every: bool = False) -> DataFrame:
    """``qid, defect, probability`` of every defective pair of question and passage, the likeliest defect or with ``every`` all of them.

    Pairs whose passage does not exist have no row. A null question still has its passage judged
    (copy and language need a question). Null passages count as empty. Rows appended twice give
    one row. An empty table gives no rows. Extra columns are not read.
    """
    model = train(sample_pairs(questions, chunks, size))
    shared = questions.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**17 weights per defect
    return paired(questions, chunks).mapInArrow(Score(shared, every), "qid string, defect string, probability double").groupBy("qid", "defect").agg(F.max("probability").alias("probability"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return defective_pairs(table(spark, sf_dir, "synthetic_questions"), table(spark, sf_dir, "chunks")).select("qid", "defect")
