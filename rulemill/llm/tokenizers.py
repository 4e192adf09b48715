"""Byte-pair encoding of whole columns with numpy matrices (problem 7).

Texts of an Arrow batch become one array of code points. The pre-tokens of the public pattern
come from comparisons of neighbouring character classes. Each distinct pre-token is encoded
once per Python worker: rows of equal padded length form a matrix, every row merges its
leftmost pair of lowest rank each round, ranks come from a hash table of pairs, and each
round compacts the rows by the one cell that the merge freed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.functions.codepoints import blocks, class_table, codepoints, segment_hashes

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
NO_RANK = np.int32(2**31 - 1)
#: Words kept in a worker's cache; a full cache is emptied, which costs time and changes nothing.
CACHE_WORDS = 200_000
#: Characters encoded at once.
BLOCK = 400_000
#: Character classes of the pre-token pattern.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Contractions that are pre-tokens of their own (fixed values of the public pattern).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte used by byte-level vocabularies, mapped to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


@dataclass
class PairTable:
    """Open-addressing hash table from a pair of ids to (rank, merged id)."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    shift: int

    @staticmethod
    def build(left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> "PairTable":
        bits = max(4, int(len(left) * 4).bit_length())
        keys = np.full(1 << bits, -1, dtype=np.int64)
        ranks = np.full(1 << bits, NO_RANK, dtype=np.int32)
        out = np.zeros(1 << bits, dtype=np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot = PairTable._slot(key, 64 - bits)
        todo = np.arange(len(key))
        while len(todo):
            free = keys[slot[todo]] == -1
            _, one = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][one]
            keys[slot[put]], ranks[slot[put]], out[slot[put]] = key[put], put, merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
        return PairTable(keys, ranks, out, 64 - bits)

    @staticmethod
    def _slot(key: np.ndarray, shift: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair, ``NO_RANK`` where there is none. Negative ids pair with nothing."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        shape, key = key.shape, key.ravel()
        rank, merged = np.full(len(key), NO_RANK, dtype=np.int32), np.zeros(len(key), dtype=np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(key[todo], self.shift)
        while len(todo):
            here = self.keys[slot]
            hit = here == key[todo]
            rank[todo[hit]], merged[todo[hit]] = self.ranks[slot[hit]], self.merged[slot[hit]]
            on = ~hit & (here != -1)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return rank.reshape(shape), merged.reshape(shape)


@dataclass
class ByteBpe:
    """A byte-level BPE vocabulary with vectorised encoding."""

    byte_ids: np.ndarray
    pairs: PairTable
    cache: dict = field(default_factory=dict)
    classes: np.ndarray | None = None

    @staticmethod
    def load(path: str = DEFAULT_VOCABULARY) -> "ByteBpe":
        """Read a vocabulary file of the ``tokenizers`` library (model type BPE, byte level)."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        symbol = byte_symbols()
        ids = np.zeros(256, dtype=np.int32)
        for ch, b in symbol.items():
            ids[b] = vocab[ch]
        left, right, merged = (np.array(x, dtype=np.int32) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        return ByteBpe(ids, PairTable.build(left, right, merged))

    # -- pre-tokens

    def _classes(self) -> np.ndarray:
        if self.classes is None:
            table = np.full(0x110000, OTHER, dtype=np.uint8)
            table[class_table(r"\s")] = SPACE
            table[class_table(r"\p{N}")] = NUMBER
            table[class_table(r"\p{L}")] = LETTER
            self.classes = table
        return self.classes

    def starts(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Positions where pre-tokens begin. Texts never share one."""
        n = len(flat)
        if not n:
            return np.zeros(0, dtype=np.int64)
        kind = self._classes()[flat]
        edge = np.zeros(n + 1, dtype=bool)  # a text begins here
        edge[offsets] = True
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        before[edge[:-1]] = 0
        begin = kind != before
        space = kind == SPACE
        # A run of white space before another character gives up its last character; if that is
        # a blank it belongs to the next pre-token, else it stands alone.
        end_of_run = space.copy()
        end_of_run[:-1] &= kind[1:] != SPACE
        end_of_run &= ~edge[1:]
        last = np.flatnonzero(end_of_run)
        begin[last] = True
        blank = last[flat[last] == 32]
        begin[blank + 1] = False
        # contractions: an apostrophe that begins a pre-token and is followed by one of the endings
        mark = np.flatnonzero((flat == 39) & begin)
        if len(mark):
            self._contract(mark, flat, kind, edge, begin)
        return np.flatnonzero(begin)

    @staticmethod
    def _contract(mark: np.ndarray, flat: np.ndarray, kind: np.ndarray, edge: np.ndarray, begin: np.ndarray) -> None:
        n = len(flat)

        def at(k: int) -> np.ndarray:
            """Characters k places on, 0 past the end of the text."""
            place = np.minimum(mark + k, n - 1)
            gone = mark + k >= n
            for j in range(1, k + 1):
                gone |= edge[np.minimum(mark + j, n)]
            return np.where(gone, 0, flat[place])

        one, two = at(1), at(2)
        size = np.zeros(len(mark), dtype=np.int64)
        for ending in CONTRACTIONS:
            hit = one == ord(ending[0])
            if len(ending) == 2:
                hit &= two == ord(ending[1])
            size[hit & (size == 0)] = len(ending)
        hit = size > 0
        mark, size = mark[hit], size[hit]
        begin[mark + 1] = False
        two_long = mark[size == 2] + 2
        begin[two_long[two_long < n]] = False
        after = mark + 1 + size
        after = after[after < n]
        # what follows the contraction begins anew, unless it is white space that keeps its own rule
        inside = ~edge[after]
        begin[after[inside & (kind[after] != SPACE)]] = True

    # -- merges

    def merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of each byte string, by matrices of rows of like length."""
        out: list[np.ndarray | None] = [None] * len(rows)
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        bucket = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for width in np.unique(bucket):
            chosen = np.flatnonzero(bucket == width)
            step = max(1, 2_000_000 // int(width))
            for a in range(0, len(chosen), step):
                part = chosen[a : a + step]
                if width > 1024:
                    for i in part:
                        out[i] = self._merge_long(rows[i])
                    continue
                cells = np.full((len(part), int(width)), -1, dtype=np.int32)
                held = np.arange(int(width)) < lengths[part][:, None]
                cells[held] = self.byte_ids[np.frombuffer(b"".join(rows[i] for i in part), dtype=np.uint8)]
                self._merge(cells, part, out)
        return out  # type: ignore[return-value]

    def _merge(self, cells: np.ndarray, owner: np.ndarray, out: list) -> None:
        rank, merged = self.pairs.look_up(cells[:, :-1], cells[:, 1:])
        while len(cells):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(cells), dtype=np.int64)
            line = np.arange(len(cells))
            done = rank[line, at] == NO_RANK if rank.shape[1] else np.ones(len(cells), dtype=bool)
            for k in np.flatnonzero(done):
                row = cells[k]
                out[owner[k]] = row[row >= 0].copy()
            keep = ~done
            cells, rank, merged, owner, at = cells[keep], rank[keep], merged[keep], owner[keep], at[keep]
            if not len(cells):
                return
            line, width = np.arange(len(cells)), cells.shape[1]
            cells[line, at] = merged[line, at]
            stay = np.ones(cells.shape, dtype=bool)
            stay[line, at + 1] = False
            cells = cells[stay].reshape(len(cells), width - 1)
            stay = np.ones(rank.shape, dtype=bool)
            stay[line, at] = False
            rank, merged = rank[stay].reshape(len(cells), width - 2), merged[stay].reshape(len(cells), width - 2)
            for shift in (-1, 0):  # the pairs on either side of the merged cell
                spot = at + shift
                ok = (spot >= 0) & (spot < width - 2)
                r, m = self.pairs.look_up(cells[line[ok], spot[ok]], cells[line[ok], spot[ok] + 1])
                rank[line[ok], spot[ok]], merged[line[ok], spot[ok]] = r, m

    def _merge_long(self, row: bytes) -> np.ndarray:
        """One very long row: each round merges every place of its lowest rank, left to right.

        A pair that holds a token made at some rank always ranks behind it, so this equals
        one merge at a time.
        """
        ids = self.byte_ids[np.frombuffer(row, dtype=np.uint8)].copy()
        while len(ids) > 1:
            rank, merged = self.pairs.look_up(ids[:-1], ids[1:])
            low = rank.min()
            if low == NO_RANK:
                break
            at = np.flatnonzero(rank == low)
            # overlapping places (a a a): within each run of neighbours every second one counts
            run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
            first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            ids[at] = merged[at]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            ids = ids[stay]
        return ids

    # -- columns

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and n+1 offsets; null and empty texts have none."""
        flats, counts = [np.zeros(0, dtype=np.int32)], np.zeros(len(texts) + 1, dtype=np.int64)
        filled = pc.fill_null(texts, "")
        for a, b in blocks(filled, BLOCK):
            ids, per_text = self._encode_block(filled[a:b])
            flats.append(ids)
            counts[a + 1 : b + 1] = per_text
        return np.concatenate(flats), np.cumsum(counts)

    def _encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, offsets = codepoints(texts)
        starts = self.starts(flat, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        ends = np.append(starts[1:], len(flat))
        one = segment_hashes(flat, starts, ends, 0x2545F4914F6CDD1D)
        code, _ = pd.factorize(one)
        first = np.zeros(code.max() + 1, dtype=np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        same = np.array_equal((ends - starts), (ends - starts)[first][code]) and np.array_equal(flat[starts], flat[starts[first]][code]) and np.array_equal(flat[ends - 1], flat[ends[first] - 1][code])
        if not same:  # two pre-tokens share a hash: take each by itself
            code = first = np.arange(len(starts))
        text = flat.tobytes()
        words = [text[4 * s : 4 * e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        cache = self.cache
        missing = list(dict.fromkeys(w for w in words if w not in cache))
        if len(cache) + len(missing) > CACHE_WORDS:
            cache.clear()
            missing = list(dict.fromkeys(words))
        if missing:
            cache.update(zip(missing, self.merge_rows([w.decode("utf-32-le").encode() for w in missing]), strict=True))
        pieces = [cache[w] for w in words]
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        pool, at = np.concatenate(pieces), np.cumsum(size) - size
        count = size[code]
        total = np.cumsum(count)
        ids = pool[np.repeat(at[code] - (total - count), count) + np.arange(int(total[-1]))]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, offsets)]
        return ids, np.diff(upto)


class Encoder:
    """Picklable map over Arrow batches: adds ``ids`` and/or ``n_tokens``; the vocabulary arrives by broadcast."""

    def __init__(self, shared, keys: list[str], text: str, ids: bool):
        self.shared, self.keys, self.text, self.ids = shared, keys, text, ids

    def __call__(self, batches):
        bpe = _worker_bpe(self.shared)
        for batch in batches:
            flat, offsets = bpe.encode(batch.column(self.text))
            out = [batch.column(k) for k in self.keys]
            if self.ids:
                out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)))
            else:
                out.append(pa.array(np.diff(offsets)))
            yield pa.RecordBatch.from_arrays(out, names=[*self.keys, "ids" if self.ids else "n_tokens"])


_BPE: dict[int, ByteBpe] = {}


def _worker_bpe(shared) -> ByteBpe:
    key = shared.value.pairs.shift, len(shared.value.pairs.keys), int(shared.value.byte_ids.sum())
    if key not in _BPE:
        _BPE.clear()
        _BPE[key] = ByteBpe(shared.value.byte_ids, shared.value.pairs, classes=shared.value.classes)
    return _BPE[key]


def _encoded(df: DataFrame, keys: list[str], text: str, vocabulary: str, ids: bool) -> DataFrame:
    spark = df.sparkSession
    bpe = ByteBpe.load(vocabulary)
    bpe._classes()  # made once here, 1 MB, not in every worker
    shared = spark.sparkContext.broadcast(bpe)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", ids array<int>" if ids else ", n_tokens bigint")
    return df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(Encoder(shared, keys, "__text", ids), schema)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Token ids of every row: ``key, ids``.

    Rows stay where they are: one scan, no shuffle. Empty and null texts have the empty list, a
    null key stays null, repeated rows are encoded each, an empty table gives no rows, other
    columns are not read. Text that looks like a special token is plain text. The broadcast
    vocabulary has a fixed size (50,000 merges, 3 MB).
    """
    return _encoded(df, [key], text, vocabulary, True)


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row; null and empty texts count 0."""
    return _encoded(df, keys, text, vocabulary, False)
