import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rulemill.operators import neardup

WORDS = [f"w{i}" for i in range(300)]


def sets(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 40 else set()


def brute(rows):
    held = {k: sets(t) for k, t in rows if k is not None}
    keys = sorted(k for k, s in held.items() if s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 2 * len(held[a] & held[b]) >= len(held[a] | held[b])}


def made(n, seed=0, template=0):
    random.seed(seed)
    rows = []
    for i in range(n):
        base = [random.choice(WORDS) for _ in range(random.randint(42, 110))]
        rows.append((f"k{i}", " ".join(base)))
        for j in range(random.choice((0, 0, 1, 2))):
            w = list(base)
            for _ in range(random.randint(1, 8)):
                at = random.randrange(len(w))
                w[at : at + random.choice((0, 1))] = [random.choice(WORDS)]
            rows.append((f"k{i}_{j}", "Re. " + ", ".join(w)))
    common = [random.choice(WORDS) for _ in range(60)]
    for i in range(template):  # a hot group: many texts that differ by one word
        w = list(common)
        w[random.randrange(60)] = f"z{i}"
        rows.append((f"t{i}", " ".join(w)))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1]), ("null", None), ("empty", ""), ("short", "a b c")], "key string, text string").withColumn("id", F.lit(1))
    got = {(r.key_a, r.key_b) for r in neardup.similar_pairs(df).collect()}
    expect = brute(rows)
    assert got <= expect and len(got) >= 0.97 * len(expect), (len(got), len(expect))
    return got, expect


def test_pairs_match_brute_force(spark):
    rows = made(250)
    got, expect = check(spark, [*rows, ("copy", rows[3][1]), ("copy2", rows[3][1])])
    assert {("copy", "copy2")} <= got and len(expect) > 100


def test_hot_group_is_spread_and_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 12)
    monkeypatch.setattr(neardup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(neardup, "TILE", 8)
    got, expect = check(spark, made(120, 1, 90))
    hot = {p for p in expect if p[0][0] == p[1][0] == "t"}
    assert len(hot) > 3000 and hot <= got


def test_groups_and_empty(spark):
    rows = made(40, 2)
    df = spark.createDataFrame([(k, "d" + k[:2], None, "[h]\n" + t) for k, t in rows] + [("n", None, None, None)], "chunk_id string, doc_id string, competition string, text string").withColumn("key", F.lit("clash"))
    groups = {r.chunk_id: (r.group, r.n_links) for r in neardup.similar_groups(df).collect()}
    for a, b in brute(rows):
        assert groups[a][0] == groups[b][0]
    assert set(groups) == {k for p in brute(rows) for k in p}
    assert neardup.similar_groups(df.limit(0)).count() == 0


def test_family_of_a_third_with_scattered_edits(spark):
    """What the members share is in a third of the texts, and their edits leave each many shingles of its own."""
    random.seed(5)
    base = [random.choice(WORDS) for _ in range(200)]
    rows = [(f"o{i}", " ".join(random.choice(WORDS) for _ in range(200))) for i in range(240)]
    for i in range(120):
        w = list(base)
        for at in random.sample(range(200), random.randint(10, 15)):
            w[at] = f"e{i}x{at}"
        rows.append((f"f{i}", " ".join(w)))
    for i in range(6):  # a member and more: over half of its shingles are its own
        rows.append((f"g{i}", " ".join(base + [f"g{i}y{k}" for k in range(190)])))
    rows.append(("base", " ".join(base)))
    df = spark.createDataFrame(rows, "key string, text string")
    got = {(r.key_a, r.key_b) for r in neardup.similar_pairs(df).collect()}
    expect = brute(rows)
    assert len(expect) > 4000 and ("base", "g0") in expect
    assert got <= expect and len(got) >= 0.97 * len(expect), (len(got), len(expect))


def test_boilerplate_loses_no_pair_in_an_exact_search(spark):
    """Texts that share 74 of 104 words: every pair has similarity 0.545, all by frequent shingles."""
    shared = [f"s{k}" for k in range(74)]
    rows = [(f"b{i:03}", " ".join(shared + [f"o{i}x{k}" for k in range(30)])) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, text string")
    assert neardup.similar_pairs(df, exact=True).count() == 400 * 399 // 2
    assert neardup.similar_pairs(df).count() >= 0.99 * 400 * 399 // 2
    assert neardup.similar_pairs(df.limit(0), exact=True).count() == 0


def test_exact_search_equals_brute_force_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 60)
    monkeypatch.setattr(neardup, "TILE", 16)
    rows = made(150, 3, 40)
    df = spark.createDataFrame(rows, "key string, text string")
    assert {(r.key_a, r.key_b) for r in neardup.similar_pairs(df, exact=True).collect()} == brute(rows)


def test_common_wording_makes_few_pairs_compared(monkeypatch):
    """Texts of a few hundred stock phrases: most share some, few are similar; equal texts of several tasks count once."""
    monkeypatch.setattr(neardup, "DIRECT", 16)
    random.seed(7)
    phrases = [" ".join(f"p{i}x{k}" for k in range(6)) for i in range(150)]
    texts = [" ".join(random.choice(phrases) for _ in range(20)) for _ in range(3000)]
    for t in texts[:100]:
        w = t.split()
        for _ in range(4):
            w[random.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    compared = []
    close = neardup.Tiles._close
    monkeypatch.setattr(neardup.Tiles, "_close", lambda self, i, j, least: compared.append(len(i)) or close(self, i, j, least))
    block = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts)], names=["id", "text"])
    stored = [row for _ in range(2) for row in neardup.Sketches(40)([block])]  # as if two tasks had read every text
    found = set()
    for i in range(neardup.ROOTS):
        for row in neardup.Tiles(0.5, i, 1)(neardup.Deal(i, i + 1, 1, {})(stored)):
            found |= set(zip(row.column(0).to_pylist(), row.column(1).to_pylist()))
    assert {(i, 3000 + i) for i in range(100)} <= found
    assert sum(compared) < 0.02 * len(texts) * (len(texts) - 1) / 2, sum(compared)
