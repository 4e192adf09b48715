"""Same or near-same records across splits (problem 3).

Records that may match agree on clause, competition and digit runs. Within that, a record is its
words in a fixed order, commonest first, the second of a word being another symbol than the first, so
that records with the same words in any order become the same sequence. Shards of evaluation sequences
are put into a compressed full-text index; training sequences stream through backward search. It
starts at the rarest words of a training record, enough that any match shares one, and gives all
maximal matches that end there. The matches of a pair of records are merged into spans and counted;
where the count, with what lies before the spans, can reach the bound, the exact count decides.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.functions.codepoints import mix64
from rulemill.functions.fmindex import FmIndex
from rulemill.functions.texts import clause_number
from rulemill.session import cut, semi_join_sized, shuffle_partitions, table

OVERLAP = 0.75
#: Distinct evaluation and training sequences of one task; a hot bucket becomes a grid of tasks.
EVAL_SHARD, TRAIN_SHARD = 40_000, 120_000
#: Located rows handled at once.
LOCATE = 2_000_000


def records(questions: DataFrame) -> DataFrame:
    """``qid, split, source, side, key, words, cid``: what two records must agree on, the sorted words, and their class.

    Rows with a null field, without words or without a clause number, and rows of other splits are
    left out. Rows appended twice stay; they have one class and make one pair.
    """
    digits = F.array_join(F.array_sort(F.expr(r"regexp_extract_all(question, '\\p{Nd}+', 0)")), " ")
    words = F.array_sort(F.expr(r"regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+', 0)"))
    rows = questions.select(
        "qid", "split", "source",
        F.when(F.col("split") == "train", "train").when(F.col("split").isin("val", "test"), "eval").alias("side"),
        F.concat_ws("\u0001", clause_number(F.col("clause")).alias("c"), F.col("competition"), digits).alias("key"),
        clause_number(F.col("clause")).alias("clause"), "competition", words.alias("words"),
    )
    rows = rows.where("qid is not null and side is not null and clause is not null and competition is not null and size(words) > 0")
    return rows.select("qid", "split", "source", "side", "key", "words", F.xxhash64("key", F.array_join("words", " ")).alias("cid"))


def _symbols(keys: pd.Series, words: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of (key, word, how often the word came before) for each of the sorted words, with n+1 offsets and the owner of each."""
    lengths = words.map(len).to_numpy(dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(words)), lengths)
    flat = pd.Series([w for ws in words for w in ws], dtype=object)
    h = pd.util.hash_array(flat.to_numpy())
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(h))
    again = place - np.maximum.accumulate(np.where(fresh, place, 0))
    with np.errstate(over="ignore"):
        h = mix64(h + again.astype(np.uint64)) * np.uint64(31) + pd.util.hash_array(keys.to_numpy(dtype=object))[owner]
    return h, offsets, owner


def _cuts(sizes: np.ndarray) -> np.ndarray:
    """Edges of runs of records with about ``LOCATE`` rows each."""
    return np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // LOCATE)) + 1, [len(sizes)]]).astype(np.int64)


def match_shard(left: pd.DataFrame, right: pd.DataFrame, share: float = OVERLAP) -> pd.DataFrame:
    """Class pairs ``train_cid, eval_cid, common`` of one shard."""
    none = pd.DataFrame({"train_cid": pd.Series(dtype="int64"), "eval_cid": pd.Series(dtype="int64"), "common": pd.Series(dtype="int32")})
    if left.empty or right.empty:  # a side without rows comes without columns
        return none
    both = set(left["key"]) & set(right["key"])
    left, right = left[left["key"].isin(both)].reset_index(drop=True), right[right["key"].isin(both)].reset_index(drop=True)
    if left.empty or right.empty:
        return none
    eh, eo, e_owner = _symbols(right["key"], right["words"])
    symbol, ids, counts = np.unique(eh, return_inverse=True, return_counts=True)
    rank = np.empty(len(symbol), dtype=np.int64)
    rank[np.lexsort((symbol, -counts))] = np.arange(len(symbol))  # rarest last, as a search begins at the end
    es = rank[ids]
    es = es[np.lexsort((es, e_owner))]
    index = FmIndex(es, eo, len(symbol))
    th, to, t_owner = _symbols(left["key"], left["words"])
    at = np.minimum(np.searchsorted(symbol, th), len(symbol) - 1)
    ts = np.where(symbol[at] == th, rank[at], len(symbol))
    ts = ts[np.lexsort((ts, t_owner))]
    ts = np.where(ts < len(symbol), ts, -1)  # what no evaluation record has is the rarest
    # words in common are at least `least` of a training record's words, whatever the other's length
    n, m = np.diff(to), np.diff(eo)
    least = np.ceil(n * share / (2 - share) * (1 - 1e-12)).astype(np.int64)
    from_end = to[1:][t_owner] - 1 - np.arange(len(ts))
    seeds = np.flatnonzero((from_end <= (n - least)[t_owner]) & (ts >= 0))
    lo, hi = index.start(ts[seeds])
    per_record = np.bincount(t_owner[seeds], weights=hi - lo, minlength=len(n)).astype(np.int64)
    out = [none]
    for a, b in itertools.pairwise(_cuts(per_record)):  # training records stream through the index
        s = seeds[(t_owner[seeds] >= a) & (t_owner[seeds] < b)]
        end, seq, length = index.maximal_matches(ts, s, to[:-1][t_owner[s]])
        train = t_owner[s[end]]
        fits = (n[train] * share <= (2 - share) * m[seq] + 1e-9) & (m[seq] * share <= (2 - share) * n[train] + 1e-9)
        end, seq, length, train = end[fits], seq[fits], length[fits], train[fits]
        if not len(end):
            continue
        pair, covered, first = merged_spans(train * len(m) + seq, s[end] - length + 1, s[end] + 1)
        train, seq = pair // len(m), pair % len(m)
        # words before the first seed that no span covers may all be common, no more
        open_words = np.minimum(to[:-1][train] + least[train] - 1, first) - to[:-1][train]
        near = 2 * (covered + np.maximum(open_words, 0)) >= share * (n[train] + m[seq]) - 1e-9
        train, seq = train[near], seq[near]
        common = _common(ts, to, es, eo, train, seq)
        ok = 2 * common >= share * (n[train] + m[seq]) - 1e-9
        out.append(pd.DataFrame({"train_cid": left["cid"].to_numpy()[train[ok]], "eval_cid": right["cid"].to_numpy()[seq[ok]], "common": common[ok].astype(np.int32)}))
    return pd.concat(out, ignore_index=True) if len(out) > 1 else none


def merged_spans(pair: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair: the places that its spans cover, each counted once, and where the first span starts."""
    order = np.lexsort((stop, start, pair))
    pair, start, stop = pair[order], start[order], stop[order]
    names, at = np.unique(pair, return_index=True)
    number = np.repeat(np.arange(len(names)), np.diff(np.append(at, len(pair))))
    size = 1 + int(stop.max())
    top = np.maximum.accumulate(number * size + stop)  # furthest end so far, by pair
    before = np.concatenate([[-1], top[:-1]])
    reached = np.where(before // size == number, before % size, 0)
    return names, np.bincount(number, weights=np.maximum(0, stop - np.maximum(start, reached))).astype(np.int64), start[at]


def _common(ts, to, es, eo, train, seq) -> np.ndarray:
    """Symbols in common of each pair of sequences; a symbol comes once in a sequence."""
    out = np.zeros(len(train), dtype=np.int64)
    for a in range(0, len(train), 50_000):
        codes = []
        for s, o, x in ((ts, to, train[a : a + 50_000]), (es, eo, seq[a : a + 50_000])):
            size = o[x + 1] - o[x]
            who = np.repeat(np.arange(len(x)), size)
            v = s[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(o[x], size)]
            codes.append((who[v >= 0] << 32) | v[v >= 0])
        both = np.sort(np.concatenate(codes))
        n = len(train[a : a + 50_000])
        out[a : a + n] = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=n)
    return out


def on_both_sides(rows: DataFrame) -> DataFrame:
    """Records whose key occurs in train and in an evaluation split; most do not, and their words are never shuffled."""
    keyed = rows.withColumn("kh", F.xxhash64("key"))
    sides = keyed.groupBy("kh").agg(F.max((F.col("side") == "train").cast("int")).alias("t"), F.max((F.col("side") == "eval").cast("int")).alias("e"))
    return cut(semi_join_sized(keyed, cut(sides.where("t = 1 and e = 1").select("kh")), "kh"))


def overlapping_classes(rows: DataFrame, share: float = OVERLAP) -> DataFrame:
    """``train_cid, eval_cid, common`` of all matching classes of records, equal ones included.

    Classes of one key go to one bucket; a bucket above the shard sizes becomes a grid of
    (evaluation shard, training shard) tasks, so a key that holds a third of all rows is spread.
    """
    spark = rows.sparkSession
    buckets = max(1, shuffle_partitions(spark))
    classes = rows.select("side", "key", "words", "cid").dropDuplicates(["side", "cid"]).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    counts = {(r[0], r[1]): r[2] for r in classes.groupBy("side", "bucket").count().collect()}  # two rows per bucket
    parts = {s: [max(1, math.ceil(counts.get((s, b), 0) / size)) for b in range(buckets)] for s, size in (("eval", EVAL_SHARD), ("train", TRAIN_SHARD))}
    n_eval, n_train = (F.element_at(F.array(*[F.lit(x) for x in parts[s]]), F.col("bucket").cast("int") + 1) for s in ("eval", "train"))
    own = F.xxhash64("cid", F.lit(1))
    e = classes.where("side = 'eval'").withColumn("e", F.pmod(own, n_eval)).withColumn("t", F.explode(F.sequence(F.lit(0), n_train - 1)))
    t = classes.where("side = 'train'").withColumn("t", F.pmod(own, n_train)).withColumn("e", F.explode(F.sequence(F.lit(0), n_eval - 1)))
    names = ("bucket", "e", "t", "key", "words", "cid")
    # both sides come from one table: names of their own keep their columns apart
    sides = [d.select(F.col("bucket").cast("int").alias(f"{p}bucket"), *(F.col(c).cast("int").alias(f"{p}{c}") for c in "et"), *(F.col(c).alias(f"{p}{c}") for c in names[3:])).groupBy(*(f"{p}{c}" for c in names[:3])) for d, p in ((t, "t_"), (e, "e_"))]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return match_shard(left.rename(columns=lambda c: c[2:]), right.rename(columns=lambda c: c[2:]), share)

    return sides[0].cogroup(sides[1]).applyInPandas(run, "train_cid bigint, eval_cid bigint, common int")


def cross_split_pairs(questions: DataFrame, share: float = OVERLAP) -> DataFrame:
    """``train_qid, eval_qid, eval_split, train_source, eval_source, common`` of every matching pair.

    A case: one question in train, one in val or test, same clause number however written, same
    competition, the same runs of digits equally often, and twice the common words (repeats counted,
    any order) at least ``share`` of the words of both. Null fields make no case; rows appended
    twice count once; an empty table gives no rows. Copies are expanded only at the end.
    """
    rows = on_both_sides(records(questions))
    pairs = overlapping_classes(rows, share)
    t = rows.where("side = 'train'").select(F.col("cid").alias("train_cid"), F.col("qid").alias("train_qid"), F.col("source").alias("train_source"))
    e = rows.where("side = 'eval'").select(F.col("cid").alias("eval_cid"), F.col("qid").alias("eval_qid"), F.col("source").alias("eval_source"), F.col("split").alias("eval_split"))
    return pairs.join(t, "train_cid").join(e, "eval_cid").where("train_qid <> eval_qid").select("train_qid", "eval_qid", "eval_split", "train_source", "eval_source", "common").distinct()


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Counts per evaluation split and source: pairs, evaluation questions and training questions."""
    return pairs.groupBy("eval_split", "eval_source").agg(F.countDistinct("train_qid", "eval_qid").alias("n_pairs"), F.countDistinct("eval_qid").alias("n_eval"), F.countDistinct("train_qid").alias("n_train"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    pairs = cross_split_pairs(table(spark, sf_dir, "synthetic_questions"))
    return pairs.select(F.least("train_qid", "eval_qid").alias("qid_a"), F.greatest("train_qid", "eval_qid").alias("qid_b")).distinct()


def p3_report(spark, sf_dir: str) -> DataFrame:
    return overlap_report(cross_split_pairs(table(spark, sf_dir, "synthetic_questions")))
