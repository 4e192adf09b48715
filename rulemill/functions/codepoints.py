"""Vectorised work on the code points of many texts at once (numpy, used inside Arrow batches)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: One past the largest code point.
UNICODE_END = 0x110000
#: Characters hashed at once.
LONG = 1 << 22
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def _ranges(pattern: str, text: str) -> np.ndarray:
    import regex

    table = np.zeros(UNICODE_END, dtype=bool)
    for m in regex.finditer(pattern, text):
        a, b = m.span()
        # the text skips the surrogates
        table[a if a < 0xD800 else a + 0x800 : (b if b <= 0xD800 else b + 0x800)] = True
    return table


@lru_cache(maxsize=1)
def all_characters() -> str:
    return "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, UNICODE_END)))


@lru_cache(maxsize=8)
def class_table(pattern: str) -> np.ndarray:
    """Truth table over code points of a one-character class such as ``\\p{L}``."""
    return _ranges(f"(?:{pattern})+", all_characters())


@lru_cache(maxsize=1)
def word_fold_table() -> np.ndarray:
    """Code point to its lower-case code point where it is a letter or digit, else 0.

    Letters and digits are ``str.isalnum`` characters and combining marks stay separators.
    """
    table = np.zeros(UNICODE_END, dtype=np.uint32)
    for c in range(UNICODE_END):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            table[c] = ord(low[0])
    return table


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array without nulls, and the n+1 offsets of its texts."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    blob = memoryview(data)[int(raw[0]) : int(raw[-1])] if data is not None else b""
    flat = np.frombuffer(str(blob, "utf-8").encode("utf-32-le"), dtype=np.uint32)
    return flat, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and those of its inverse."""
    n = 1 << bits
    with np.errstate(over="ignore"):
        up, down = (np.full(n, b, dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return up, down


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of each segment ``values[start:end]``, by prefix sums of a polynomial with an odd base."""
    if len(values) > LONG and len(starts) > 1:  # a very long text: by parts, so that the tables of powers stay small
        out, a = np.empty(len(starts), dtype=np.uint64), 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + LONG // 2)))
            lo, hi = int(starts[a]), int(ends[a:b].max())
            out[a:b] = segment_hashes(values[lo:hi], starts[a:b] - lo, ends[a:b] - lo, base)
            a = b
        return out
    bits = max(10, int(len(values)).bit_length())
    up, down = _powers(bits, base)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix64(values.astype(np.uint64) + np.uint64(base & 0xFFFF)) * up[: len(values)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MULTIPLIER)


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of letters and digits, lower case) of many texts.

    Returns the folded code points, the start and the end of each word, and for each text the
    index of its first word (n+1 values). No word crosses two texts.
    """
    folded = word_fold_table()[flat]
    on = folded != 0
    first = on.copy()
    first[1:] &= ~on[:-1]
    last = on.copy()
    last[:-1] &= ~on[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flat))]
    first[inner] |= on[inner]
    last[inner - 1] |= on[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return folded, starts, ends, np.searchsorted(starts, offsets)


def blocks(texts: pa.Array, size: int = 1_000_000):
    """Row ranges ``(a, b)`` of a string array with about ``size`` characters each; a longer text stands alone."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    total, a = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield a, i
            total, a = 0, i
        total += n
    if a < len(texts):
        yield a, len(texts)
