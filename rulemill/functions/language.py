"""Main language of many texts at once: script by letters, Latin languages by function words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from rulemill.functions.codepoints import UNICODE_END, segment_hashes

LANGUAGES = ("?", "en", "fr", "es", "de", "it", "pt", "nl", "ar", "hi", "zh", "ja", "th", "ru", "ko", "el", "he")
CODE = {name: i for i, name in enumerate(LANGUAGES)}
#: Function words that point to one Latin-script language among these (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to is are be been has have with for from that this which when where who what how if or not may must shall will should can under before after during on at by an as it its was were than until while does",
    "fr": "le les des du et est une dans pour que qui sur avec ne pas au aux sont ce cette après sans peut doit ou même si pendant par être ont été son ses quand tant",
    "es": "el los las y del en con por para que se su al es lo como más pero sus le ya está puede debe sin aunque cuando porque tras hasta después antes desde fue una otra",
    "de": "der die das und ist den dem des ein eine einen nicht mit von zu auf für im sich auch werden wird nach bei aus wenn oder kann muss ohne falls sobald während bevor weil obwohl solange nachdem noch am zum gilt",
    "it": "il gli della delle che è per non sono una alla dal nel dei più anche come questo prima dopo senza può deve quando",
    "pt": "os das dos não uma em para com são ao pela pelo mais também como depois antes sem pode deve quando até você",
    "nl": "het een van de is dat niet op te zijn voor met aan er ook bij naar uit kan moet zonder wanneer totdat terwijl wordt",
}
#: Code point ranges of scripts (fixed values).
SCRIPTS = {
    1: [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    CODE["ar"]: [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    CODE["hi"]: [(0x900, 0x97F)],
    CODE["zh"]: [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    CODE["ja"]: [(0x3040, 0x30FF)],
    CODE["th"]: [(0xE00, 0xE7F)],
    CODE["ru"]: [(0x400, 0x52F)],
    CODE["ko"]: [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
    CODE["el"]: [(0x370, 0x3FF)],
    CODE["he"]: [(0x590, 0x5FF)],
}
WORD_BASE = 0x5851F42D4C957F2D
#: Function words that decide a language: at least this many, and this many times the second.
LEAST, LEAD = 2, 1.3


@lru_cache(maxsize=1)
def _scripts() -> np.ndarray:
    table = np.zeros(UNICODE_END, dtype=np.uint8)
    for code, ranges in SCRIPTS.items():
        for a, b in ranges:
            table[a : b + 1] = code
    return table


@lru_cache(maxsize=1)
def _function_words() -> tuple[np.ndarray, np.ndarray]:
    owner: dict[str, set[int]] = {}
    for lang, listed in FUNCTION_WORDS.items():
        for w in listed.split():
            owner.setdefault(w, set()).add(CODE[lang])
    single = {w: next(iter(o)) for w, o in owner.items() if len(o) == 1}
    names = list(single)
    flat = np.array([ord(c) for w in names for c in w], dtype=np.uint32)
    size = np.array([len(w) for w in names])
    ends = np.cumsum(size)
    hashes = segment_hashes(flat, ends - size, ends, WORD_BASE)
    order = np.argsort(hashes)
    return hashes[order], np.array([single[w] for w in names], dtype=np.uint8)[order]


def main_languages(flat: np.ndarray, offsets: np.ndarray, word_hashes: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    """Code of the main language of each text, 0 where it cannot be told.

    ``word_hashes`` are ``segment_hashes`` of the folded words with ``WORD_BASE``.
    """
    n = len(offsets) - 1
    kinds = len(LANGUAGES)
    script = _scripts()[flat]
    text = np.repeat(np.arange(n), np.diff(offsets))
    letters = np.bincount(text * kinds + script, minlength=n * kinds).reshape(n, kinds)
    letters[:, 0] = 0
    letters[:, CODE["zh"]] += letters[:, CODE["ja"]] * (letters[:, CODE["ja"]] * 10 <= letters[:, CODE["zh"]])
    japanese = letters[:, CODE["ja"]] * 10 > letters[:, CODE["zh"]]
    letters[:, CODE["ja"]] += np.where(japanese, letters[:, CODE["zh"]], 0)
    letters[japanese & (letters[:, CODE["ja"]] > 0), CODE["zh"]] = 0
    # a letter of a script without an alphabet weighs about three
    letters[:, [CODE["zh"], CODE["ja"], CODE["ko"]]] *= 3
    out = letters.argmax(axis=1)
    total = letters.max(axis=1)
    known, lang = _function_words()
    at = np.minimum(np.searchsorted(known, word_hashes), len(known) - 1)
    hit = known[at] == word_hashes
    owner = np.repeat(np.arange(n), np.diff(first_word))[hit]
    counts = np.bincount(owner * kinds + lang[at[hit]], minlength=n * kinds).reshape(n, kinds)
    ordered = np.sort(counts, axis=1)
    latin = np.where((ordered[:, -1] >= LEAST) & (ordered[:, -1] >= LEAD * ordered[:, -2]), counts.argmax(axis=1), 0)
    return np.where(total == 0, 0, np.where(out == 1, latin, out)).astype(np.int64)
