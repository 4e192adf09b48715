import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulemill.llm import leakage, mixing, pairs, sentences, tokenizers

VOCABULARY = tokenizers.DEFAULT_VOCABULARY
DATA = "/root/testdata/sf0.001"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")


# -- tokens


@pytest.fixture(scope="module")
def bpe():
    return tokenizers.ByteBpe.load(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "it's don't 'll we've  'd\n\n  x", "''s x're'", "\n a", "\t\tb", "a  b", "Z" * 5000, "ab" * 3000, "aaaaaaa" * 300, "<|endoftext|> a", "ภาษาไทย 日本語 हिन्दी 🏏🔥", "\r\n\r\n x", "1'd2 ½ x²", "é​­"]


@needs_vocabulary
def test_tokens_equal_the_library(bpe, library):
    flat, at = bpe.encode(pa.array([*TEXTS, None]))
    for i, e in enumerate(library.encode_batch(TEXTS, add_special_tokens=False)):
        assert flat[at[i] : at[i + 1]].tolist() == e.ids
    assert at[-1] == at[-2]


@needs_vocabulary
@given(st.lists(st.text(max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_tokens_of_any_text(bpe, library, texts):
    flat, at = bpe.encode(pa.array(texts, pa.string()))
    assert [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@needs_vocabulary
def test_encode_corpus_cases(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, "", 9), (None, None, 9), (1, "a b", 9)], "doc_id bigint, text string, ids int").withColumn("__text", F.lit("clash"))
    rows = [(r.doc_id, r.ids) for r in tokenizers.encode_corpus(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, [64, 275]), (1, [64, 275]), (2, []), (None, [])], key=str)
    assert tokenizers.encode_corpus(df.limit(0)).count() == 0


# -- sentences


def parts(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


@pytest.mark.parametrize(
    "text",
    [
        ["Dr. Smith met Prof. J. P. Jones of St. Ives.", "They left at 5 p.m.", "He stayed."],
        ["The rate fell to 7.2, i.e. 10.8% below cl. 39.4.7.", "See www.a.example or x_v1.3.pdf at once.", "Mail a@b.example or call ext. 8 now."],
        ["He wrote: “It was dead. Nobody heard.”", "(See No. 4 of the notes.)", "“Why?” asked the keeper.", "“Must it?”"],
        ["They waited … and left…", "Well... it went on.", "Who knows?!", "iScore shows it."],
        ["Am 24. Mai traf Dr. Ort z. B. auf 6 Spieler.", "Vgl. Nr. 6.5 usw. im Anhang.", "Warum das?"],
        ["« Il part ! » cria la foule.", "M. Dupont et Mme Roy ont vu l'art. 17.4.", "Cf. p. 25 du recueil."],
        ["¡La delegada firma!", "El Sr. Paz leyó el art. 6.2.", "¿Por qué?"],
        ["هل يبقى خلف الحبل؟", "قال د. Smith إن الأمر واضح.", "بلغ المعدل 2.79 في اليوم."],
        ["डॉ. Smith ने कहा।", "“यह नियम।” ऐसा नियम 3.4 में लिखा है।"],
    ],
)
def test_spaced_scripts(text):
    assert parts(" ".join(text)) == text


def test_scripts_without_blanks():
    zh = ["守门员获得五分罚分吗？", "（见第12.9条。）", "“主裁判应留在界绳之外！”队长说。", "记分员推迟比赛……守门员也同意！"]
    assert parts("".join(zh)) == zh
    ja = ["得点率は1.94だった。", "「権利を失う。」と主審は言った。", "（第18.9条を見よ。）", "残るのか？"]
    assert parts("".join(ja)) == ja
    assert parts("ผู้ตัดสินหลักนับใหม่ภายใน 26 นาที  ฝ่ายตั้งรับขอเปลี่ยนลูก") == ["ผู้ตัดสินหลักนับใหม่ภายใน 26 นาที", "ฝ่ายตั้งรับขอเปลี่ยนลูก"]
    assert "也" in sentences.lattice().segment("守门员也同意") and "酒吧" in sentences.lattice().segment("我在酒吧喝水")


@pytest.mark.parametrize(
    "text",
    [
        ["今天比赛开始了吗", "我们去看吧", "如果下雨就不去"],
        ["今天开始了", "我们去看。"],
        ["我们在酒吧我们喝水。"],
        ["試合は始まりますか", "もし雨なら中止です"],
        ["あれは雨かもしれない。", "終わり。"],
        ["กรรมการมาแล้วครับ", "ถ้าฝนตกการแข่งขันจะหยุด"],
        ["“我知道。”他的朋友们和所有在场的观众都在比赛结束以后一起大声地对裁判委员会说。"],
    ],
)
def test_gaps_by_particles_and_opening_words(text):
    joined = "".join(text)
    joined = joined.replace("开始了我们", "开始了 我们")
    assert parts(joined) == text


def test_file_names_stay_whole():
    assert parts("Open the file Report.Docx now. It ends.The next.") == ["Open the file Report.Docx now.", "It ends.", "The next."]


def test_units_and_missing_blanks():
    assert parts("LAW 6 HELMETS\r\n \r\n1. the striker\n\n- a bail\n\nIt ends.The next\nline runs on. ") == ["LAW 6 HELMETS", "1. the striker", "- a bail", "It ends.", "The next\nline runs on."]
    assert parts("") == parts(" \n\n ") == [] and parts(None) == [] and len(parts("x. " * 50_000)) >= 1


@given(st.text(alphabet=st.sampled_from("aB. \n!?\"“”()1。…ก"), max_size=120))
@settings(max_examples=200, deadline=None)
def test_spans_cover_all_but_blanks(text):
    at = 0
    for a, b in sentences.sentence_spans(text):
        assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_split_sentences_cases(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (None, "X y.")], "doc_id bigint, text string").withColumn("key", F.lit("clash")).withColumn("start_pos", F.lit(0))
    assert sorted(((r.doc_id, r.start_pos, r.end_pos) for r in sentences.split_sentences(df).collect()), key=str) == sorted([(1, 0, 4), (1, 5, 9), (None, 0, 4)], key=str)
    assert sentences.split_sentences(df.limit(0)).count() == 0


# -- leaks

GOLD = "Suppose the old umpire loses his spectacles near the heavy roller while seven juniors watch, who pays for repairs afterwards?"


def plain_leak(wanted, text, share=0.65, stretch=1.5):
    """Longest common subsequence in every window, directly."""
    need, width = int(np.ceil(share * len(wanted) - 1e-9)), int(stretch * len(wanted) + 1e-9)
    for s in range(len(text)):
        row = [0] * (len(wanted) + 1)
        for w in text[s : s + width]:
            old = row[:]
            for i, x in enumerate(wanted):
                row[i + 1] = max(old[i + 1], row[i], old[i] + (w == x))
        if row[-1] >= need:
            return True
    return False


def test_leaks_match_plain_search(spark):
    random.seed(4)
    words = leakage.split_words(GOLD)
    rows = []
    for i in range(120):
        w = list(words)
        for _ in range(random.randint(0, 12)):
            at = random.randrange(len(w) + 1)
            w[at : at + random.choice((0, 1))] = random.choice(([], ["filler"], ["the", "x"]))
        if random.random() < 0.2:
            random.shuffle(w)
        rows.append((str(i), "Before that. " + " ".join(w).upper() + "! After.", 0))
    df = spark.createDataFrame([*rows, ("n", None, 0), ("e", "", 0)], "key string, text string, item_id int")
    items = spark.createDataFrame([("g", GOLD, None), ("none", None, None), ("blank", "?", "")], "item_id string, question string, answer string")
    got = {r.key: (r.start_pos, r.end_pos) for r in leakage.find_passages(df, items).collect()}
    expect = {k for k, t, _ in rows if plain_leak(words, leakage.split_words(t))}
    assert set(got) == expect and 10 < len(expect) < 120
    for k, (a, b) in got.items():
        assert plain_leak(words, leakage.split_words(dict((r[0], r[1]) for r in rows)[k][a:b]))
    assert leakage.find_passages(df.limit(0), items).count() == 0 and leakage.find_passages(df, items.limit(0)).count() == 0


def test_leaks_name_questions(spark):
    answer = "The striker shall record a short run when both captains agree."
    q = spark.createDataFrame([("q1", GOLD, "c9"), ("q2", "other", "c1"), ("q2", "other", "c1"), ("q3", None, None), (None, GOLD, "c1")], "qid string, question string, pos_chunk_id string")
    c = spark.createDataFrame([("c1", f"[h]\nx {GOLD} y"), ("c1", f"[h]\nx {GOLD} y"), ("c2", f"[{GOLD}]\nonly the header"), ("c9", f"[h]\nSo: {answer}")], "chunk_id string, text string")
    g = spark.createDataFrame([("g", GOLD, answer)], "id string, question string, answer_short string")
    got = {(r.item_id, r.qid, r.field, r.place) for r in leakage.leaks(q, c, g).collect()}
    assert got == {("g", "q1", "question", "question"), ("g", "q2", "question", "passage"), ("g", "q1", "answer", "passage")}
    short, part = "Fourteen pearl buttons.", "He said the striker shall record one short run when both the captains agree, no more."
    c = spark.createDataFrame([("c1", "[h]\nIt cost fourteen pearl buttons in all."), ("c9", f"[h]\n{part}")], "chunk_id string, text string")
    g = spark.createDataFrame([("s", None, short), ("p", None, answer), ("one", None, "pearl")], "id string, question string, answer_short string")
    places = {(r.item_id, r.field, r.place) for r in leakage.leaks(q, c, g).collect()}
    assert places == {("s", "answer", "passage"), ("one", "answer", "passage")}, places


# -- pairs


def test_defects_of_held_out_pairs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    q, c = spark.read.parquet(f"{DATA}/synthetic_questions.parquet"), spark.read.parquet(f"{DATA}/chunks.parquet")
    sample = pairs.sample_pairs(q, c)
    model = pairs.train(sample[: len(sample) // 2])
    rng = np.random.default_rng(11)
    held = [(a or "", b or "") for a, b in sample[len(sample) // 2 :]]
    clean = [x for x, k in zip(held, model.decide(pairs.features(pa.array([a for a, _ in held], pa.string()), pa.array([b for _, b in held], pa.string()))), strict=True) if k < 0]
    qs, ps, y, _ = pairs.made_pairs(clean, rng)
    got = model.decide(pairs.features(pa.array(qs, pa.string()), pa.array(ps, pa.string())))
    truth = np.where(y.any(axis=1), y.argmax(axis=1), -1)
    assert (got == truth).mean() > 0.9
    for k in range(len(pairs.DEFECTS)):
        assert (got[truth == k] == k).mean() > 0.75, pairs.DEFECTS[k]


def test_question_said_again_and_again_is_a_copy():
    model = pairs.train(pairs.plain_pairs(400, np.random.default_rng(1)))
    ask = "May the captain of the visiting team ask the umpire for a second review of the decision that was made in the last over before the interval when both scorers disagree?"
    answered = f"{ask} " + " ".join(p for _, p in pairs.plain_pairs(4, np.random.default_rng(2)))
    said = [" ".join([ask] * k) for k in (1, 2, 3, 5, 8)]
    got = model.decide(pairs.features(pa.array([ask] * 6, pa.string()), pa.array([*said, answered], pa.string())))
    assert [pairs.DEFECTS[k] if k >= 0 else "ok" for k in got] == ["copy"] * 5 + ["ok"]


def test_long_refusal_is_found():
    model = pairs.train(pairs.plain_pairs(400, np.random.default_rng(1)))
    ask = "May the captain ask for a review before the interval when both scorers disagree?"
    refused = f"I'm sorry, but I can't help with that. You asked: “{ask}” As an assistant I cannot state this for safety reasons. " + "I am not able to give this information because no source was supplied; please ask a qualified official. " * 6
    sound = " ".join(p for _, p in pairs.plain_pairs(6, np.random.default_rng(2)))
    noise = "0123abc45d" * 200  # long, and in no language
    f = pairs.features(pa.array([ask] * 3, pa.string()), pa.array([refused, sound, noise + "."], pa.string()))
    assert len(refused.split()) > 90 and len(sound.split()) > 90
    assert [pairs.DEFECTS[k] if k >= 0 else "ok" for k in model.decide(f)] == ["refusal", "ok", "ok"]


def test_pairs_cases(spark):
    ask = "May the runner return to the crease after the umpire has called over at the end?"
    sound = "Both sides wait behind the line until play is resumed. A captain shall be told of it before each new ball is bowled in that session."
    cases = {"ok": sound, "empty": "N/A", "copy": ask, "refusal": "I'm sorry, but I cannot answer this question.", "truncated": sound[:90], "language": pairs.FOREIGN["fr"]}
    names = {k: f"c_{k}" for k in cases}
    q = spark.createDataFrame([(k, ask, names[k]) for k in cases] + [("ok", ask, "c_ok"), ("gone", ask, "nowhere"), ("null", None, "c_empty"), (None, ask, "c_ok")], "qid string, question string, pos_chunk_id string").withColumn("passage", F.lit("clash"))
    c = spark.createDataFrame([(names[k], f"[h]\n{p}") for k, p in cases.items()] + [("c_ok", f"[h]\n{sound}"), (None, "x")], "chunk_id string, text string")
    got = sorted((r.qid, r.defect) for r in pairs.defective_pairs(q, c).collect())
    expect = {(k, k) for k in cases if k != "ok"} | {("null", "empty")}
    # seven pairs teach little of how passages end, so the broken-off one may be missed here
    assert len(got) == len(set(got)) and expect - {("truncated", "truncated")} <= set(got) <= expect
    assert pairs.defective_pairs(q.limit(0), c).count() == 0 and pairs.defective_pairs(q, c.limit(0)).count() == 0


# -- mixing


@needs_vocabulary
def test_mix(spark):
    random.seed(0)
    docs = [(i, " ".join(random.choice(("bat", "ball", "umpire", "over")) for _ in range(random.randint(1, 60))), random.choice(("A", " a", "b-c", "B_C"))) for i in range(400)]
    docs += [(900 + i, "same text here", "tiny") for i in range(3)] + [(1000, None, "a"), (1001, "", None), (1002, "x", "unnamed")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("salt", F.lit(1)).withColumn("n_tokens", F.lit(7))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b_c", 0.4, 2), ("tiny", 0.05, 60), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix_sources(df, targets)
    rows = {r.doc_id: r for r in mixed.collect()}
    assert set(rows) == {d[0] for d in docs} and rows[1000].repeats == rows[1001].repeats == rows[1002].repeats == 0
    cap = {"a": 1, "b_c": 2, "tiny": 60}
    assert all(r.repeats <= cap.get(r.clean_source, 0) for r in rows.values())
    shares = {r.clean_source: r for r in mixing.mix_report(mixed, targets).collect()}
    for name, share in (("a", 0.5), ("b_c", 0.4), ("tiny", 0.05)):
        assert abs(shares[name].actual_share - share / 0.95) < 0.01
    assert shares["absent"].tokens_used == 0
    assert mixing.mix_sources(df.limit(0), targets).count() == 0
    assert all(r.repeats == 0 for r in mixing.mix_sources(df, targets.limit(0)).collect())


def test_no_kind_of_defect_is_ruled_out():
    """Broken-off Thai, long refusals, questions said again and again, languages outside every list, several defects at once."""
    model = pairs.train(pairs.plain_pairs(400, np.random.default_rng(1)))
    ask = "May the captain report the decision before the interval when both captains agree?"
    thai = pairs.FOREIGN["th"]
    long_refusal = " ".join(["I cannot answer this question because no source was supplied.", "My guidelines do not let me answer.", "I refuse to answer this.", "No answer can be given here at this time."] * 5)
    swedish = "Kaptenen får inte lämna planen innan domaren har gett sitt tillstånd, och spelet återupptas först efter att regnet har upphört helt."
    cases = [(thai, thai[: thai.index("ก่อน") + 4], "truncated"), (thai, thai, "ok"), (ask, long_refusal, "refusal"), (ask, " ".join([ask] * 5), "copy"), (ask, swedish, "language")]
    f = pairs.features(pa.array([q for q, _, _ in cases], pa.string()), pa.array([p for _, p, _ in cases], pa.string()))
    assert len(long_refusal.split()) > 133
    assert [pairs.DEFECTS[k] if k >= 0 else "ok" for k in model.decide(f)] == [d for _, _, d in cases]
    assert model.margins(f).shape == (5, len(pairs.DEFECTS))
