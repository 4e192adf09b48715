"""Evaluation texts leaking into training text (problem 2).

One Aho-Corasick automaton holds, over normalised text (lower-case words with one blank
between), the seed words of every test question and every whole test answer. Each text is
scanned once. Seed hits that lie close enough together name the few (text, item) pairs for
which an exact dynamic program finds the shortest stretch that keeps the item's words in
their order; word positions map back to offsets in the original text.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.functions.codepoints import blocks, codepoints, words
from rulemill.functions.texts import passage
from rulemill.session import table

SHARE = 0.65
STRETCH = 1.5
#: Test items per automaton; more are scanned for in further passes.
ITEMS_PER_PASS = 20_000
#: Rows looked at to rank words by how common they are. Any ranking gives the same result.
RANK_ROWS = 2_000


def split_words(text: str) -> list[str]:
    """Words of one text, as ``functions.codepoints.words`` finds them."""
    flat, offsets = codepoints(pa.array([text]))
    folded, starts, ends, _ = words(flat, offsets)
    return ["".join(map(chr, folded[a:b].tolist())) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Matcher:
    """Test items prepared for scanning; picklable, the automaton is built in each worker."""

    def __init__(self, items: list[tuple[str, str | None, str | None]], common: Counter, share: float = SHARE, stretch: float = STRETCH):
        self.share, self.stretch = share, stretch
        self.questions, self.need, self.window, self.seeds, self.hits = [], [], [], defaultdict(list), []
        self.answers = []
        for item, question, answer in items:
            found, said = split_words(question or ""), split_words(answer or "")
            if found:
                self._add(item, found, common)
            if said:
                self.answers.append((item, said))
        self.seeds = dict(self.seeds)
        self._ready = None

    def _add(self, item: str, found: list[str], common: Counter) -> None:
        n = len(found)
        need = math.ceil(self.share * n - 1e-9)
        # At most n - need words may be missing, so of any more seed words some must occur.
        order = sorted(range(n), key=lambda i: (common[found[i]], found[i], i))
        seeds = order[: min(n, n - need + max(1, need // 2))]
        k = len(self.questions)
        self.questions.append((item, found))
        self.need.append(need)
        self.window.append(math.floor(self.stretch * n + 1e-9))
        self.hits.append(max(1, len(seeds) - (n - need)))
        for w in sorted({found[i] for i in seeds}):
            self.seeds[w].append(k)

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def prepare(self):
        if self._ready is None:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            names = list(self.seeds)
            for i, w in enumerate(names):
                automaton.add_word(f" {w} ", i)
            phrases: dict[str, list[int]] = defaultdict(list)
            for i, (_, said) in enumerate(self.answers):
                phrases[" " + " ".join(said) + " "].append(i)
            owners = list(phrases.values())
            for i, p in enumerate(phrases):
                automaton.add_word(p, len(names) + i)
            if len(automaton):
                automaton.make_automaton()
            counts = np.array([len(self.seeds[w]) for w in names], dtype=np.int64)
            flat = np.array([k for w in names for k in self.seeds[w]], dtype=np.int64)
            self._ready = automaton, len(names), counts, np.cumsum(counts) - counts, flat, owners, np.array(self.hits, dtype=np.int64), np.array(self.window, dtype=np.int64)
        return self._ready

    def scan(self, texts: pa.Array) -> list[tuple[int, str, str, int, int]]:
        """``(row, item, field, start, end)`` of every leak in the texts, offsets in code points."""
        automaton, n_seeds, counts, begins, flat_items, owners, hits, window = self.prepare()
        out: list[tuple[int, str, str, int, int]] = []
        filled = pc.fill_null(texts, "")
        for a, b in blocks(filled):
            flat, offsets = codepoints(filled[a:b])
            folded, starts, ends, first = words(flat, offsets)
            if not len(starts) or not len(automaton):
                continue
            # normalised text: every word with a blank before it, texts separated by two blanks and a line feed
            lengths = ends - starts
            size = lengths + 1
            place = np.cumsum(size) - size
            extra = np.repeat(np.arange(len(first) - 1), np.diff(first)) * 3
            place = place + extra
            total = int(place[-1] + size[-1]) + 3
            normal = np.full(total, 32, dtype=np.uint32)
            normal[np.repeat(place + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = folded[folded != 0]
            last = first[1:][np.diff(first) > 0] - 1
            normal[place[last] + size[last] + 1] = 10
            text = normal.tobytes().decode("utf-32-le")
            found = [(e, p) for e, p in automaton.iter(text)]
            if not found:
                continue
            hit = np.array(found, dtype=np.int64)
            word = np.searchsorted(place, hit[:, 0] - 1, side="right") - 1  # a match ends on the blank after its last word
            row = np.searchsorted(first, word, side="right") - 1
            seed = hit[:, 1] < n_seeds
            for w, r, p in zip(word[~seed].tolist(), row[~seed].tolist(), hit[~seed, 1].tolist(), strict=True):
                for i in owners[p - n_seeds]:
                    item, said = self.answers[i]
                    out.append((a + r, item, "answer", int(starts[w - len(said) + 1] - offsets[r]), int(ends[w] - offsets[r])))
            which, word, row = hit[seed, 1], word[seed], row[seed]
            if not len(which):
                continue
            c = counts[which]
            item = flat_items[np.repeat(begins[which] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
            word, row = np.repeat(word, c), np.repeat(row, c)
            order = np.lexsort((word, row, item))
            item, word, row = item[order], word[order], row[order]
            ahead = np.arange(len(item)) + hits[item] - 1
            ok = ahead < len(item)
            t = np.minimum(ahead, len(item) - 1)
            ok &= (item[t] == item) & (row[t] == row) & (word[t] - word < window[item])
            for r, k in sorted(set(zip(row[ok].tolist(), item[ok].tolist(), strict=True))):
                lo, hi = int(first[r]), int(first[r + 1])
                said = ["".join(map(chr, folded[s:e].tolist())) for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
                span = self.shortest(k, said)
                if span:
                    out.append((a + r, self.questions[k][0], "question", int(starts[lo + span[0]] - offsets[r]), int(ends[lo + span[1]] - offsets[r])))
        return out

    def shortest(self, k: int, text: list[str]) -> tuple[int, int] | None:
        """First and last word of the shortest stretch that holds enough of item ``k`` in order, if short enough."""
        wanted, need = self.questions[k][1], self.need[k]
        spots = defaultdict(list)
        for i, w in enumerate(wanted):
            spots[w].append(i)
        # best[i][l]: latest start of l words kept in order out of the first i words of the item
        best = np.full((len(wanted) + 1, need + 1), -1, dtype=np.int64)
        answer = None
        for j, w in enumerate(text):
            for i in reversed(spots.get(w, ())):
                reach = np.concatenate([[j], best[i, 1:need]])
                np.maximum(best[i + 1 :, 1:], reach, out=best[i + 1 :, 1:])
                s = int(reach[need - 1])
                if s >= 0 and (answer is None or j - s < answer[1] - answer[0]):
                    answer = s, j
        return answer if answer and answer[1] - answer[0] + 1 <= self.window[k] else None


class Scan:
    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batches):
        matcher = self.shared.value
        for batch in batches:
            found = matcher.scan(batch.column(1))
            rows = pa.array([f[0] for f in found], type=pa.int64())
            cols = [batch.column(0).take(rows), *(pa.array([f[i] for f in found], type=t) for i, t in ((1, pa.string()), (2, pa.string()), (3, pa.int64()), (4, pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "item_id", "field", "start_pos", "end_pos"])


def find_passages(texts: DataFrame, items: DataFrame, share: float = SHARE, stretch: float = STRETCH) -> DataFrame:
    """``key, item_id, field, start_pos, end_pos`` of every test item found in ``texts(key, text)``.

    ``items`` has item_id, question and answer. Field ``question``: a stretch of at most
    ``stretch`` times the question's words holds at least ``share`` of them in order (the shortest
    such stretch). Field ``answer``: the whole answer occurs, however short it is (a rule's wording is common, so a part of it names no leak). One scan of the
    texts and no shuffle; the items, a stated query set, are scanned for in blocks of bounded size.
    Null, empty and wordless texts and items match nothing; repeated rows give repeated results.
    """
    spark = texts.sparkSession
    items = items.select(F.col("item_id").cast("string"), F.col("question").cast("string"), F.col("answer").cast("string")).where("item_id is not null")
    total = items.count()
    passes = max(1, -(-total // ITEMS_PER_PASS))
    common = Counter(w for r in texts.select("text").limit(RANK_ROWS).toLocalIterator() for w in set(split_words(r[0] or "")))
    out = None
    for p in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        shared = spark.sparkContext.broadcast(Matcher([tuple(r) for r in part.toLocalIterator()], common, share, stretch))
        found = texts.select(F.col("key").cast("string"), F.col("text").cast("string")).mapInArrow(Scan(shared), "key string, item_id string, field string, start_pos bigint, end_pos bigint")
        out = found if out is None else out.unionByName(found)
    return out


def leaks(questions: DataFrame, chunks: DataFrame, golden: DataFrame, answers: bool = True) -> DataFrame:
    """Training questions touched by test items: ``item_id, qid, field, place, start_pos, end_pos``.

    ``place`` is ``question`` or ``passage``; offsets count from the start of the question or of the
    passage. Passages are scanned where they lie and only hits are joined with the questions.
    """
    items = golden.select(F.col("id").alias("item_id"), "question", (F.col("answer_short") if answers else F.lit(None)).alias("answer"))
    asked = questions.select("qid", "question", "pos_chunk_id").where("qid is not null")
    in_question = find_passages(asked.select(F.col("qid").alias("key"), F.col("question").alias("text")), items)
    in_passage = find_passages(chunks.select(F.col("chunk_id").alias("key"), passage(F.col("text")).alias("text")), items).distinct()
    pairs = asked.select("qid", "pos_chunk_id").where("pos_chunk_id is not null").distinct()
    joined = in_passage.join(pairs, in_passage["key"] == pairs["pos_chunk_id"]).select("item_id", "qid", "field", F.lit("passage").alias("place"), "start_pos", "end_pos")
    direct = in_question.select("item_id", F.col("key").alias("qid"), "field", F.lit("question").alias("place"), "start_pos", "end_pos")
    return direct.unionByName(joined).distinct()


def p2_found(spark, sf_dir: str) -> DataFrame:
    all_leaks = leaks(table(spark, sf_dir, "synthetic_questions"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "golden_items"), answers=False)
    return all_leaks.where("field = 'question'").select("item_id", "qid").distinct()
