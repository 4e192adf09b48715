"""Near-duplicate passages with small edits (problem 6).

Plan: (1) per text a signature of four-bit min-hashes and the keys of some roots, pairs of min-hashes,
over all its shingles, kept in one row per block of texts; (2) texts that share a root meet in one
task, a few roots at a time. Within a root's group only texts that also agree in some set of places of
the signature are compared, by exclusive-or and bit counts; small groups, and those in which that saves
nothing, are compared tile by tile, pairs of tiles whose shingle counts differ beyond the radius being
skipped; (3) the surviving pairs are verified exactly on their texts. Equal texts are one class from the
start. An exact search compares all tiles, by bitmaps whose differing bits never outnumber the
differing shingles.

No shingle is left out as frequent: wording that many texts have may be all that two of them share.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.functions.codepoints import blocks, codepoints, mix64, segment_hashes, words
from rulemill.functions.texts import passage
from rulemill.operators.components import connected_components
from rulemill.session import cut, release, shuffle_partitions, table

SHINGLE, SIMILARITY, LEAST_WORDS = 3, 0.5, 40
#: Roots, min-hashes of each, and roots that are dealt out at once (their rows are on disk together).
ROOTS, ROWS, ROUND = 24, 2, 8
#: Four-bit min-hashes of the signature; pairs that agree in fewer than AGREE are not similar (a pair of
#: similarity 0.5 exactly does so with 1e-3), nor those in fewer than AGREE_HALF of the first 32.
PLACES, AGREE, AGREE_HALF = 96, 36, 6
#: Sets of places of each root, and places of a set; texts of one set agree in its places by selection, so that more must.
SETS, SET, AGREE_SET = 64, 5, 39
#: Rows of a root's group up to which all are compared, and sets from which the others' pairs are estimated.
DIRECT, TRIED = 400, 4
#: Rows of a tile, and rows of a group above which it is spread over a grid of tasks (in an exact search: EXACT_ROWS).
TILE, HOT, EXACT_ROWS = 512, 200_000, 20_000
#: Texts that one task compares and pairs that one task verifies, about; the number of tasks grows with both.
TASK_ROWS, TASK_PAIRS = 250_000, 20_000
#: Characters of texts that are sketched and packed at once.
BLOCK = 4_000_000
#: 64-bit words of a bitmap in an exact search.
BITMAP = 8
#: One text in so many is looked at to find large groups; that decides the spread, not the result.
HOT_SAMPLE = 64
WORD_BASE, SEED = 0x5851F42D4C957F2D, 20_240_611


#: Bits of a shingle's hash that counts and sketches work with; verification takes all 64.
SHORT = 44


def _shingles(texts: pa.Array, size: int):
    """Shingle hashes and owners in order of the text, and the number of words of each text."""
    flat, offsets = codepoints(texts)
    folded, starts, ends, first = words(flat, offsets)
    h = segment_hashes(folded, starts, ends, WORD_BASE)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), n_words
    last = len(h) - size + 1
    inside = owner[:last] == owner[size - 1 :]
    s = np.zeros(last, dtype=np.uint64)
    for k in range(size):
        s = s * np.uint64(0x100000001B3) + h[k : k + last]
    return mix64(s[inside]), owner[:last][inside], n_words


def short_sets(texts: pa.Array, size: int = SHINGLE):
    """Distinct shortened shingle hashes of each text with n+1 offsets, and the number of words of each."""
    s, who, n_words = _shingles(texts, size)
    both = np.sort((who.astype(np.uint64) << np.uint64(SHORT)) | (s >> np.uint64(64 - SHORT)))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    owner = (both >> np.uint64(SHORT)).astype(np.int64)
    return both & np.uint64((1 << SHORT) - 1), np.searchsorted(owner, np.arange(len(n_words) + 1)), n_words


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """Distinct shingle hashes of each text, ordered by text, with n+1 offsets; and the number of words of each."""
    s, who, n_words = _shingles(texts, size)
    order = np.lexsort((s, who))
    s, who = s[order], who[order]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (who[1:] != who[:-1])
    s, who = s[keep], who[keep]
    return s, np.searchsorted(who, np.arange(len(n_words) + 1)), n_words


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    """A mask and an odd factor for each hash function."""
    pairs = np.random.default_rng(SEED).integers(1, 2**63, size=(PLACES + ROOTS * ROWS, 2), dtype=np.uint64)
    pairs[:, 1] = pairs[:, 1] * np.uint64(2) + np.uint64(1)
    return pairs


def _minima(s: np.ndarray, offsets: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least hash of each text's shingles for each factor; texts must have one at least."""
    out = np.empty((len(offsets) - 1, len(factors)), dtype=np.uint64)
    s = mix64(s)
    for k, (mask, factor) in enumerate(factors):
        v = s ^ mask
        v *= factor
        out[:, k] = np.minimum.reduceat(v, offsets[:-1])
    return out


@lru_cache(maxsize=ROOTS)
def _sets(root: int) -> np.ndarray:
    """The sets of places that a root's group is divided by; each root has its own, so that a pair missed by one is met by another."""
    rng = np.random.default_rng((SEED, root))
    return np.array([rng.choice(PLACES, SET, replace=False) for _ in range(SETS)])


#: Columns of a block of texts, and of what it deals to one part.
STORED = "ids binary, sizes binary, signs binary, roots binary"
PACKED = "part int, ids binary, sizes binary, signs binary, keys binary"
#: Of a packed shingle count: the row is off the diagonal of its group's grid, and which of the two salts the text has.
OFF, SIDE = np.uint32(1 << 31), np.uint32(1 << 30)


def _arrays(batch, first: int, kinds):
    """The arrays of each row of a batch, from column ``first`` on."""
    for i in range(batch.num_rows):
        yield [np.frombuffer(batch.column(first + k)[i].as_buffer(), dtype=t) for k, t in enumerate(kinds)]


def bitmaps(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bitmap of each set in which every member turns one bit over; two sets differ in as many members as bits, at least."""
    bit = (mix64(s) >> np.uint64(40)) % np.uint64(64 * BITMAP)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    odd = np.bincount(row * (64 * BITMAP) + bit.astype(np.int64), minlength=(len(offsets) - 1) * 64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 64 * BITMAP), axis=1, bitorder="little").view(np.uint64)


class Sketches:
    """Ids, shingle counts, signatures and root keys of the texts, one row per block of texts.

    In an exact search there is one root, whose key all texts have, and bitmaps stand for signatures.
    """

    def __init__(self, least_words: int, exact: bool = False):
        self.least_words, self.exact = least_words, exact

    def __call__(self, batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in blocks(batch.column(1), BLOCK):
                s, offsets, n_words = short_sets(batch.column(1)[a:b])
                fresh = []
                for x in ids[a:b].tolist():
                    fresh.append(x not in seen)
                    seen.add(x)
                size = np.diff(offsets)
                use = np.array(fresh, dtype=bool) & (n_words >= self.least_words) & (size > 0)
                if use.any():
                    yield self._block(ids[a:b][use], s[np.repeat(use, size)], size[use])

    def _block(self, ids, s, size):
        offsets = np.concatenate([[0], np.cumsum(size)])
        if self.exact:
            root, sign = np.zeros((len(ids), 1), dtype=np.uint32), bitmaps(s, offsets)
        else:
            low = mix64(_minima(s, offsets, _factors()))
            pairs = low[:, PLACES:].reshape(len(ids), ROOTS, ROWS)
            key = np.zeros((len(ids), ROOTS), dtype=np.uint64)
            for r in range(ROWS):
                key = mix64(key + pairs[:, :, r])
            root = (key >> np.uint64(32)).astype(np.uint32)
            four = (low[:, :PLACES] >> np.uint64(11)).astype(np.uint8) & np.uint8(15)
            sign = four[:, ::2] | four[:, 1::2] << np.uint8(4)
        row = (ids.tobytes(), size.astype(np.uint32).tobytes(), np.ascontiguousarray(sign).tobytes(), np.ascontiguousarray(root.T).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["ids", "sizes", "signs", "roots"])


class SampledRoots:
    """Root keys of one text in HOT_SAMPLE."""

    def __call__(self, batches):
        for batch in batches:
            for ids, roots in _arrays(batch.select(["ids", "roots"]), 0, (np.int64, np.uint32)):
                key = roots.reshape(-1, len(ids))[:, mix64(ids.view(np.uint64)) % np.uint64(HOT_SAMPLE) == 0]
                at = np.repeat(np.arange(len(key), dtype=np.int32), key.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(key.ravel().astype(np.int64))], names=["root", "key"])


class Deal:
    """Each block's texts by part: every root has ``each`` parts, a text is in one of them (in several if its group is spread)."""

    def __init__(self, first: int, last: int, each: int, hot: dict):
        self.first, self.last, self.each, self.hot = first, last, each, hot

    def __call__(self, batches):
        for batch in batches:
            for ids, size, sign, roots in _arrays(batch, 0, (np.int64, np.uint32, np.uint64, np.uint32)):
                sign, roots = sign.reshape(len(ids), -1), roots.reshape(-1, len(ids))
                cols: list[list] = [[] for _ in range(5)]
                for i in range(self.first, self.last):
                    key, who, flags = self._spread(i, ids, roots[i])
                    part = ((mix64(key) >> np.uint64(20)) % np.uint64(self.each)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    part, key, who, flags = part[order], key[order], who[order], flags[order]
                    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                    for x, y in zip(edges[:-1], edges[1:]):
                        own = who[x:y]
                        for c, v in zip(cols, (int(part[x]) + (i - self.first) * self.each, ids[own].tobytes(), (size[own] | flags[x:y]).tobytes(), sign[own].tobytes(), key[x:y].tobytes())):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "ids", "sizes", "signs", "keys"])

    def _spread(self, root, ids, key):
        """Keys, texts and flags; the key of a large group becomes the keys of the grid cells in which its text has to be."""
        who, none = np.arange(len(ids)), np.zeros(len(ids), dtype=np.uint32)
        if root not in self.hot:
            return key, who, none
        keys, salts = self.hot[root]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        n = salts[at[hit]].astype(np.int64)
        mine = mix64(ids.view(np.uint64)[hit]) % n.astype(np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        other = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        first, second = np.minimum(mine[row], other), np.maximum(mine[row], other)
        cell = (mix64(mix64(key[hit][row]) + mix64(first * np.uint64(1_000_003) + second + np.uint64(1))) >> np.uint64(32)).astype(np.uint32)
        flags = np.where(first != second, OFF | np.where(mine[row] == first, SIDE, np.uint32(0)), np.uint32(0)).astype(np.uint32)
        return np.concatenate([key[~hit], cell]), np.concatenate([who[~hit], who[hit][row]]), np.concatenate([none[~hit], flags])


LOWEST = np.uint64(0x1111111111111111)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing four-bit values of two arrays of words: exclusive-or, then a count of the values that are not zero."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    x &= LOWEST
    return np.bitwise_count(x)


#: Bits of a row's number, and of its values in a set, where rows are sorted by group and set.
ROW_BITS, SET_BITS = 22, 4 * SET


class Tiles:
    """Compares the texts of each root's group; yields candidate pairs of ids, smaller first."""

    def __init__(self, similarity: float, first: int, each: int, exact: bool = False):
        self.similarity, self.first, self.each, self.exact = similarity, first, each, exact

    def __call__(self, batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, arrays in zip(batch.column(0).to_pylist(), _arrays(batch, 1, (np.int64, np.uint32, np.uint64, np.uint32))):
                held.setdefault(part, []).append((*arrays[:2], arrays[2].reshape(len(arrays[0]), -1), arrays[3]))
        while held:
            part, rows = held.popitem()
            ids, size, sign, key = (np.concatenate(x) for x in zip(*rows))
            del rows
            pairs: list[np.ndarray] = []
            many = 0
            for found in self._part(self.first + part // self.each, ids, size, sign, key):
                pairs.append(found)
                many += len(found)
                if many > 500_000:
                    yield self._rows(pairs)
                    pairs, many = [], 0
            if many:
                yield self._rows(pairs)

    def _part(self, root, ids, size, sign, key):
        flag, size = (size >> np.uint32(30)).astype(np.int8), (size & (SIDE - np.uint32(1))).astype(np.int32)
        order = np.lexsort((ids, size, key))
        same = (key[order][1:] == key[order][:-1]) & (ids[order][1:] == ids[order][:-1])
        order = order[np.concatenate([[True], ~same])]  # a text that several tasks have read
        same = key[order][1:] == key[order][:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        if not len(order):
            return
        self.ids, self.size, self.flag, key = ids[order], size[order], flag[order], key[order]
        self.spread = bool(self.flag.any())
        self.words = [np.ascontiguousarray(sign[order, k]) for k in range(sign.shape[1])]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(begin, len(key)))
        small = length <= DIRECT
        yield from self._runs(np.arange(len(key)), begin[small], length[small], AGREE)
        begin, length = begin[~small], length[~small]
        dense = np.ones(len(begin), dtype=bool)
        lo = 0
        while lo < len(begin) and not self.exact:
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(length[lo:]), 1 << (ROW_BITS - 1), side="right")) + lo)
            dense[lo:hi] = yield from self._by_sets(_sets(root), begin[lo:hi], length[lo:hi])
            lo = hi
        for lo, n in zip(begin[dense].tolist(), length[dense].tolist()):
            yield from self._all(lo, lo + n)

    def _by_sets(self, sets, begin, length):
        """Compares the rows of each group that agree in a set of places; returns the groups in which that saves nothing."""
        dense = length >= 1 << ROW_BITS
        met = np.zeros(len(length))
        for tried in (True, False):  # first the pairs of some sets are counted
            rows = np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(b, b + n) for b, n in zip(begin[~dense].tolist(), length[~dense].tolist()))])
            if not len(rows):
                break
            group = np.repeat(np.flatnonzero(~dense), length[~dense]).astype(np.uint64) << np.uint64(ROW_BITS + SET_BITS) | np.arange(len(rows), dtype=np.uint64)
            octets = np.concatenate([np.ascontiguousarray(w[rows].view(np.uint8).reshape(-1, 8).T) for w in self.words])
            for places in sets[:TRIED] if tried else sets:
                value = np.zeros(len(rows), dtype=np.uint32)
                for p in places.tolist():
                    value = value << np.uint32(4) | (octets[p >> 1] >> np.uint8(4 * (p & 1)) & np.uint8(15))
                order = np.sort(group | value.astype(np.uint64) << np.uint64(ROW_BITS))
                kind = order >> np.uint64(ROW_BITS)
                edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
                start, n = edge[:-1], np.diff(edge)
                start, n = start[n > 1], n[n > 1]
                if tried:
                    np.add.at(met, (kind[start] >> np.uint64(SET_BITS)).astype(np.int64), n * (n - 1.0) / 2)
                else:
                    yield from self._runs(rows[(order & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)], start, n, AGREE_SET)
            if tried:
                dense |= met * (len(sets) / TRIED) + length * float(DIRECT / 2) >= length * (length - 1.0) / 2
        return dense

    def _runs(self, rows, begin, length, least):
        """All pairs of each run of rows, all runs at once, by distance."""
        at = np.concatenate([np.zeros(0, dtype=np.int64), np.repeat(begin, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)])
        end = np.repeat(begin + length, length)
        for d in range(1, int(length.max(initial=1))):
            on = at + d < end
            at, end = at[on], end[on]
            for x in range(0, len(at), 1_000_000):
                found = self._close(rows[at[x : x + 1_000_000]], rows[at[x : x + 1_000_000] + d], least)
                if len(found):
                    yield found

    def _all(self, lo, hi):
        """All pairs of a group, tile by tile."""
        size = self.size
        for a in range(lo, hi, TILE):
            for b in range(a, hi, TILE):
                i, j = slice(a, min(a + TILE, hi)), slice(b, min(b + TILE, hi))
                if size[b] * self.similarity > size[i.stop - 1] + 2:
                    break  # counts ascend: this and all later tiles are beyond the radius
                if self.exact:
                    differ = np.zeros((i.stop - a, j.stop - b), dtype=np.int32)
                    for w in self.words:
                        differ += np.bitwise_count(w[i][:, None] ^ w[j][None, :])
                    # shortened hashes may make a set seem a little smaller than it is
                    ok = differ <= (size[i][:, None] + size[j][None, :] + 4) * ((1 - self.similarity) / (1 + self.similarity))
                else:
                    differ = np.zeros((i.stop - a, j.stop - b), dtype=np.uint8)
                    for w in self.words:
                        differ += differing(w[i][:, None], w[j][None, :])
                    ok = differ <= PLACES - AGREE
                x, y = np.nonzero(ok)
                x, y = x + a, y + b
                found = self._pairs(x[x < y], y[x < y])
                if len(found):
                    yield found

    def _close(self, i, j, least):
        if self.exact:
            differ = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int32) for w in self.words)
            ok = differ <= (self.size[i] + self.size[j] + 4) * ((1 - self.similarity) / (1 + self.similarity))
            return self._pairs(i[ok], j[ok])
        half = differing(self.words[0][i], self.words[0][j]) + differing(self.words[1][i], self.words[1][j])
        ok = np.flatnonzero(half <= 32 - AGREE_HALF)
        i, j, half = i[ok], j[ok], half[ok]
        for w in self.words[2:]:
            half += differing(w[i], w[j])
        ok = half <= PLACES - least
        return self._pairs(i[ok], j[ok])

    def _pairs(self, i, j):
        ok = (self.size[i] + 2 >= self.similarity * self.size[j]) & (self.size[j] + 2 >= self.similarity * self.size[i])
        if self.spread:  # off the diagonal of a grid only pairs across the two salts count
            ok &= (self.flag[i] == 0) | (self.flag[i] != self.flag[j])
        a, b = self.ids[i[ok]], self.ids[j[ok]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)

    @staticmethod
    def _rows(pairs):
        p = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["id_a", "id_b"])


class Verify:
    """Exact similarity of both texts of each pair; a text that several pairs of a block have is read once."""

    def __init__(self, similarity: float, least_words: int):
        self.similarity, self.least_words = similarity, least_words

    def __call__(self, batches):
        for batch in batches:
            out = [np.zeros(0)]
            for a, b in blocks(batch.column(2), 3_000_000):
                out.append(self._of(batch.slice(a, b - a)))
            s = np.concatenate(out)
            ok = pa.array(np.flatnonzero(s >= self.similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok), pa.array(s[s >= self.similarity])], names=["id_a", "id_b", "similarity"])

    def _of(self, batch):
        n = batch.num_rows
        both = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        _, at, text = np.unique(both, return_index=True, return_inverse=True)
        texts = pa.chunked_array([batch.column(2), batch.column(3)]).take(pa.array(at)).combine_chunks()
        s, o, w = shingle_sets(texts)
        _, code = np.unique(s, return_inverse=True)
        size = np.diff(o)
        shared = np.zeros(n, dtype=np.int64)
        step = max(1, int(4_000_000 / (2 * max(1.0, size.mean()))))
        for x in range(0, n, step):
            a, b = text[x : min(n, x + step)], text[n + x : n + min(n, x + step)]
            sides = []
            for t in (a, b):
                k = size[t]
                place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(o[t], k)
                sides.append(np.repeat(np.arange(len(t), dtype=np.uint64), k) << np.uint64(32) | code[place].astype(np.uint64))
            m = np.sort(np.concatenate(sides))
            shared[x : x + len(a)] = np.bincount((m[1:][m[1:] == m[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(a))
        a, b = text[:n], text[n:]
        total = size[a] + size[b] - shared
        return np.where((w[a] >= self.least_words) & (w[b] >= self.least_words) & (total > 0), shared / np.maximum(total, 1), 0)


def _classes(items: DataFrame) -> DataFrame:
    """``id, text`` with the id of a text's class: texts that are equal have one id."""
    return items.select(F.xxhash64("text").alias("id"), "text")


def _halves(batches):
    """The upper halves of all ids of a partition, packed."""
    held = [np.zeros(0, dtype=np.uint32)]
    for batch in batches:
        held += [(c.to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.uint32) for c in batch.columns]
    yield pa.RecordBatch.from_arrays([pa.array([np.unique(np.concatenate(held)).tobytes()], pa.binary())], names=["ids"])


def _among(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that ``pairs`` name, and about one in a thousand more, without a shuffle of the others.

    Ids are told by their upper halves, 4 bytes each in the driver and in every worker; joins by the whole id follow.
    """
    packed = pairs.select("id_a", "id_b").mapInArrow(_halves, "ids binary").collect()
    named = texts.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, dtype=np.uint32), *(np.frombuffer(r[0], dtype=np.uint32) for r in packed)])))

    @F.pandas_udf("boolean")
    def known(ids: pd.Series) -> pd.Series:
        half = (ids.to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        return pd.Series(np.append(named.value, np.uint64(1 << 32))[np.searchsorted(named.value, half)] == half)

    return texts.where(known("id"))


def similar_classes(items: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs ``id_a, id_b, similarity`` of classes of equal texts, and the members ``id, key`` of all classes that were looked at.

    The smaller id comes first; a class of two or more keys is paired with itself.

    ``items`` has key and text. The id is the 64-bit hash of the text. Only texts of at least
    ``least_words`` words take part. Similarity is that of the sets of three-word shingles.
    With ``exact`` all tiles are compared, by bitmaps that lose no pair: the work then grows with
    the square of the texts.
    """
    spark = items.sparkSession
    n_texts = items.select(F.lit(1)).count()  # texts are not read for this
    eligible = _classes(items.where("text is not null")).where(F.length("text") >= 2 * least_words - 1)
    stored = cut(eligible.mapInArrow(Sketches(least_words, exact), STORED))
    if exact:
        grid = -(-n_texts // min(HOT, EXACT_ROWS))
        hot, roots, each = {0: (np.zeros(1, dtype=np.uint32), np.array([grid]))}, 1, max(shuffle_partitions(spark), grid * (grid + 1) // 2)
    else:
        often = stored.mapInArrow(SampledRoots(), "root int, key bigint").groupBy("root", "key").count().where(F.col("count") * HOT_SAMPLE > HOT)
        found = sorted((r[0], r[1], -(-r[2] * HOT_SAMPLE // HOT) + 1) for r in often.collect())  # few: each holds HOT rows of its root
        hot = {i: (np.array([k for x, k, _ in found if x == i], dtype=np.uint32), np.array([n for x, _, n in found if x == i])) for i in {x for x, _, _ in found}}
        roots, each = ROOTS, max(1, -(-shuffle_partitions(spark) // ROUND), n_texts // TASK_ROWS)
    rounds = []
    for first in range(0, roots, ROUND):
        last = min(roots, first + ROUND)
        dealt = stored.mapInArrow(Deal(first, last, each, hot), PACKED).repartitionById((last - first) * each, F.col("part"))
        rounds.append(cut(dealt.mapInArrow(Tiles(similarity, first, each, exact), "id_a bigint, id_b bigint").distinct()))
        del dealt
        release(spark)
    met = reduce(DataFrame.union, rounds)
    name = F.xxhash64("key")
    copies = items.where("text is not null").select(F.xxhash64("text").alias("id"), name.alias("name")).groupBy("id").agg(F.min("name").alias("x"), F.max("name").alias("y"))
    copies = copies.where("x <> y").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    candidates = cut(met.union(copies).distinct())
    members = cut(_among(items.where("text is not null").select(F.xxhash64("text").alias("id"), "key", "text"), candidates))
    spread = max(shuffle_partitions(spark), candidates.count() // TASK_PAIRS)
    held = members.select("id", "text").repartition(spread, "id").dropDuplicates(["id"])
    a, b = held.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), held.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    pairs = candidates.repartition(spread, "id_a").join(a, "id_a").repartition(spread, "id_b").join(b, "id_b").select("id_a", "id_b", "text_a", "text_b")
    links = cut(pairs.mapInArrow(Verify(similarity, least_words), "id_a bigint, id_b bigint, similarity double"))
    return links, members.select("id", "key").distinct()


def similar_pairs(items: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, exact: bool = False) -> DataFrame:
    """``key_a, key_b, similarity`` of all pairs of different keys with similar texts, smaller first.

    A key that comes twice with one text counts once. Null keys and texts, and texts of too few
    words, have no row; an empty table gives none. Copies are expanded only here, at the end.
    """
    links, held = similar_classes(items.where("key is not null"), similarity, least_words, exact)
    a, b = held.select(F.col("id").alias("id_a"), F.col("key").alias("key_1")), held.select(F.col("id").alias("id_b"), F.col("key").alias("key_2"))
    out = links.join(a, "id_a").join(b, "id_b").where("key_1 <> key_2 and (id_a <> id_b or key_1 < key_2)")
    return out.select(F.least("key_1", "key_2").alias("key_a"), F.greatest("key_1", "key_2").alias("key_b"), "similarity").distinct()


def passages(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("key"), passage(F.col("text").cast("string")).alias("text"))


def similar_groups(chunks: DataFrame) -> DataFrame:
    """``chunk_id, group, n_links`` of every passage that is near another, plus its document and competition.

    The group is the component of the links between classes, named by its least chunk_id; n_links
    counts the classes that a passage's class is linked with.
    """
    items = passages(chunks).where("key is not null and text is not null")
    links, held = similar_classes(items)
    labels = connected_components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    other = links.where("id_a <> id_b")
    degree = other.select(F.col("id_a").alias("id")).union(other.select("id_b")).groupBy("id").agg(F.count("*").alias("n_links"))
    rows = held.join(labels.withColumnRenamed("node", "id"), "id").join(degree, "id", "left")
    names = rows.groupBy("component").agg(F.min("key").alias("group"))
    about = chunks.select("chunk_id", "doc_id", "competition").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("competition").alias("competition"))
    named = rows.join(names, "component").select(F.col("key").alias("chunk_id"), "group", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return about.join(named, "chunk_id").select("chunk_id", "doc_id", "competition", "group", "n_links")


def p6_found(spark, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(passages(table(spark, sf_dir, "chunks")))
    return pairs.select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p6_groups(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "chunks"))
