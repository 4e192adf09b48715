import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulemill.functions.fmindex import FmIndex, suffix_array
from rulemill.functions.subset_sum import nearest_subset
from rulemill.operators import overlap, splits, splitting
from rulemill.operators.components import connected_components

QUESTION = "qid string, question string, pos_chunk_id string, doc_id string, clause string, competition string, split string, source string"


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=60, deadline=None)
def test_suffix_array(text):
    sa = suffix_array(np.array(text, dtype=np.int64))
    assert sorted(range(len(text)), key=lambda i: text[i:]) == sa.tolist()


@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=8), min_size=1, max_size=6), st.lists(st.integers(-1, 4), min_size=1, max_size=10))
@settings(max_examples=80, deadline=None)
def test_maximal_matches(texts, pattern):
    flat = np.array([x for t in texts for x in t])
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ends = np.arange(len(pattern))
    which, seq, length = FmIndex(flat, offsets, 5).maximal_matches(np.array(pattern), ends, np.zeros(len(ends), dtype=np.int64))
    expect = []
    for e in range(len(pattern)):
        for i, t in enumerate(texts):
            for k in range(len(t)):
                n = 0
                while n <= min(e, k) and pattern[e - n] == t[k - n]:
                    n += 1
                if n:
                    expect.append((e, i, n))
    assert sorted(zip(which.tolist(), seq.tolist(), length.tolist())) == sorted(expect)


def test_pairs_come_from_matches_and_spans(monkeypatch):
    """Without matches there are no pairs, and merged spans count every word of a pair once."""
    words = [["a", "b", "c", "d"], ["a", "a", "b", "x"], ["p", "q"]]
    side = lambda o: pd.DataFrame({"key": ["k"] * 3, "words": words, "cid": [o, o + 1, o + 2]})
    got = overlap.match_shard(side(0), side(10))
    assert set(zip(got["train_cid"], got["eval_cid"], got["common"])) == {(0, 10, 4), (1, 11, 4), (2, 12, 2)}
    pair, covered, first = overlap.merged_spans(np.array([1, 1, 1, 0]), np.array([2, 0, 6, 5]), np.array([5, 3, 8, 6]))
    assert pair.tolist() == [0, 1] and covered.tolist() == [1, 7] and first.tolist() == [5, 0]
    nothing = np.zeros(0, dtype=np.int64)
    monkeypatch.setattr(FmIndex, "maximal_matches", lambda *a: (nothing, nothing, nothing))
    assert overlap.match_shard(side(0), side(10)).empty


def brute_overlap(rows):
    out, seen = set(), {}
    for r in rows:
        if None in (r[0], r[1], r[4], r[5], r[6]) or not re.search(r"\d", r[4]):
            continue
        seen[r[0]] = (r[6], re.search(r"\d+(\.\d+)*", r[4]).group(), r[5], Counter(re.findall(r"\d+", r[1])), Counter(re.findall(r"[^\W_]+", r[1].lower())))
    items = list(seen.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if (x[0] == "train") != (y[0] == "train") and x[1:4] == y[1:4] and 2 * sum((x[4] & y[4]).values()) >= 0.75 * (sum(x[4].values()) + sum(y[4].values())) and x[4] and y[4]:
                out.add((min(a, b), max(a, b)))
    return out


def test_overlap_matches_brute_force(spark, monkeypatch):
    random.seed(5)
    base = ["may the innings be closed early at 20 overs", "who signals first when light fades", "is a fresh guard needed at 20"]
    rows = []
    for i in range(160):
        w = random.choice(base).split()
        for _ in range(random.randint(0, 3)):
            w[random.randrange(len(w))] = random.choice(["x", "y", "20", "the"])
        if random.random() < 0.3:
            random.shuffle(w)
        rows.append((f"q{i}", " ".join(w), "c", "d", random.choice(["1.1", "Clause 1.1", "2.2"]), random.choice(["laws", "ipl"]), random.choice(["train", "val", "test"]), "s"))
    rows += [("n1", None, None, None, "1.1", "laws", "val", None), ("n2", "x", "c", "d", None, "laws", "val", "s"), ("n3", "", "c", "d", "1.1", "laws", "val", "s"), (None, "x", "c", "d", "1.1", "laws", "val", "s"), rows[0]]
    df = spark.createDataFrame(rows, QUESTION).withColumn("key", F.lit("clash")).withColumn("cid", F.lit(1)).withColumn("words", F.lit(None).cast("string"))
    expect = brute_overlap(rows)
    assert len(expect) > 30
    for size in (40_000, 7):  # whole buckets, and a grid of small shards
        monkeypatch.setattr(overlap, "EVAL_SHARD", size)
        monkeypatch.setattr(overlap, "TRAIN_SHARD", size)
        got = overlap.cross_split_pairs(df).collect()
        assert {(min(r.train_qid, r.eval_qid), max(r.train_qid, r.eval_qid)) for r in got} == expect
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0
    assert overlap.overlap_report(overlap.cross_split_pairs(df)).agg(F.sum("n_pairs")).first()[0] == len(expect)


def test_components_match_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (7, None), (None, 8)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=6), st.integers(0, 120), st.booleans())
@settings(max_examples=150, deadline=None)
def test_subset_sum_is_nearest(cells, goal, over):
    take = nearest_subset(list(cells), list(cells.values()), goal, over)
    assert all(0 <= k <= cells[n] for n, k in take.items())
    sums = {0}
    for n, c in cells.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    got = sum(n * k for n, k in take.items())
    allowed = [s for s in sums if over or s <= goal]
    assert abs(goal - got) == min(abs(goal - s) for s in allowed)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), min_size=1, max_size=8), st.integers(0, 9_000))
@settings(max_examples=150, deadline=None)
def test_filled_subset_sum_keeps_its_bound(cells, goal):
    take = nearest_subset(list(cells), list(cells.values()), goal, False, 64)
    got, left = sum(n * k for n, k in take.items()), [n for n, c in cells.items() if take.get(n, 0) < c]
    assert got <= goal and all(0 <= k <= cells[n] for n, k in take.items())
    assert not left or goal - got < min(left)


def test_large_subset_sum_fills():
    take = nearest_subset([700, 1100, 3], [4000, 4000, 50], 5_000_000)
    assert abs(sum(n * k for n, k in take.items()) - 5_000_000) <= 3


def test_splits_keep_ties_together(spark):
    random.seed(2)
    rows = [(f"q{i}", "t", f"c{random.randrange(150)}", f"d{random.randrange(90)}" if random.random() < 0.8 else None, "1", "laws", "train", "s") for i in range(300)]
    rows += [("lone", None, None, None, None, None, None, None), (None, "x", "c1", "d1", "1", "l", "train", "s"), rows[0]]
    rows += [(f"s{i}", "t", f"only{i}", None, "1", "laws", "train", "s") for i in range(400)]
    df = spark.createDataFrame(rows, QUESTION).withColumn("component", F.lit("clash")).withColumn("x", F.lit(0))
    got = {r.qid: (r.component, r.split) for r in splits.assign_splits(df).collect()}
    assert set(got) == {r[0] for r in rows if r[0]}
    by = defaultdict(set)
    for r in rows:
        if r[0]:
            for key in (("d", r[3]), ("c", r[2])):
                if key[1]:
                    by[key].add(got[r[0]])
    assert all(len(s) == 1 for s in by.values())
    n = Counter(s for _, s in got.values())
    assert abs(n["test"] - 70) <= 2 and abs(n["val"] - 70) <= 2
    assert splits.assign_splits(df.limit(0)).count() == 0 and splits.tied_documents(df.limit(0)).count() == 0
    pairs = {(r.doc_id_a, r.doc_id_b) for r in splits.tied_documents(df).collect()}
    assert all(a < b for a, b in pairs)
    comp = {r[3]: got[r[0]][0] for r in rows if r[0] and r[3]}
    assert pairs == {(a, b) for a in comp for b in comp if a < b and comp[a] == comp[b]}


@given(st.text(alphabet=st.sampled_from("ab.\n é字。1 (-"), max_size=400), st.integers(20, 60), st.integers(0, 15))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_and_fit(text, limit, overlap_size):
    pieces = splitting.split_text(text, limit, overlap_size)
    at = len(text) - len(text.lstrip())
    for start, end, own in pieces:
        assert 0 < end - start <= limit and own - start <= overlap_size and start <= own < end
        assert not text[at:own].strip()
        at = end
    assert not text[at:].strip()


def test_pieces_follow_the_tree():
    def section(mark, n):
        return f"{mark}\n\n" + " ".join(f"Sentence {k} of {mark.split()[-1]} is here." for k in range(n)) + "\n\n"

    text = "# A\n\n" + section("## A1", 14) + section("## A2", 14) + "# B\n\n" + section("## B1", 14) + section("## B2", 14)
    assert [text[own:].split("\n")[0] for _, _, own in splitting.split_text(text, 1_200, 0)] == ["# A", "# B"]
    # only the chapter that is too long opens, at its own sections
    text = "# A\n\n" + section("## A1", 25) + section("## A2", 25) + "# B\n\n" + section("## B1", 14)
    assert [text[own:].split("\n")[0] for _, _, own in splitting.split_text(text, 1_200, 0)] == ["# A", "## A2", "# B"]
    # items of the inner list stay with their outer item
    items = "".join(f"{i}. Outer item number {i}.\n" + "".join(f"   ({c}) inner part {c} of item {i}\n" for c in "abcd") for i in range(1, 5))
    assert all(items[own:].startswith(f"{n}.") for n, (_, _, own) in zip((1, 3), splitting.split_text(items, 300, 0), strict=True))
    places, depths = splitting.boundaries("Intro:\n1. one\n(a) x\n(i) deep\n(ii) deep\n(b) y\n2. two\n\nText.\n")
    assert depths == [40, 21, 22, 23, 23, 22, 21, 10]


def test_pieces_cut_at_boundaries(spark):
    body = "\n\n".join(f"LAW {i} TITLE\n" + " ".join(f"Sentence {k} of law {i} is here." for k in range(12)) for i in range(1, 9))
    for start, _, own in splitting.split_text(body, 600, 60):
        assert own == 0 or body[own - 1].isspace()
        assert body[own:].startswith(("LAW", "Sentence")) and (start == own or body[start - 1].isspace())
    assert [e - s for s, e, _ in splitting.split_text("x" * 40, 15, 5)] == [10, 15, 15, 15]
    long_text = "[h]\n" + "word " * 400
    rows = [("a", "1", 3, 5, long_text), ("a", "1", 3, 5, long_text), ("b", None, None, None, long_text), ("s", "1", 1, 1, "[h]\nshort"), ("n", "1", 1, 1, None), ("e", "1", 1, 1, ""), ("w", "1", 1, 1, "[h]\n" + " " * 3000)]
    df = spark.createDataFrame(rows, "chunk_id string, clause string, page_start int, page_end int, text string").withColumn("passage", F.lit("clash")).withColumn("piece", F.lit(0))
    got = splitting.split_oversized(df).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in got} == {"a", "b"} and [r.piece for r in got if r.chunk_id == "a"] == [0, 1]
    assert all(len(r.text) <= 1500 and r.end_pos - r.start_pos == len(r.text) for r in got)
    a = [r for r in got if r.chunk_id == "a"]
    assert a[0].page_start == 3 and a[-1].page_end == 5 and all(3 <= r.page_start <= r.page_end <= 5 for r in a) and got[-1].page_start is None
    assert splitting.split_oversized(df.limit(0)).count() == 0
