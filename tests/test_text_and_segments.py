from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulemill.functions.texts import clause_number, passage
from rulemill.operators import chunking, segment, textprep

PAGES = [
    ("d", 1, "Some preamble text\nLAW 1 The players ........ 3"),
    ("d", 2, "LAW 1 THE PLAYERS\n1.1  Number of players\nA match is played between two sides."),
    ("d", 3, "LAW 2 THE UMPIRES\n2.1\nAppointment of umpires\nBefore the match two umpires are named.\n2.1.1 They shall be present."),
    ("d", 4, "APPENDIX A\nDEFINITIONS AND EXPLANATIONS\nA.1 The match\nA single match."),
]


def one(spark, col, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(col(F.col("x"))).collect()]


def test_normalize_and_page_numbers(spark):
    assert one(spark, textprep.normalize_line, "LAW 40\t \x07TIMED OUT", "3.1  Correctness of scores", None) == ["LAW 40 TIMED OUT", "3.1 Correctness of scores", None]
    hits = one(spark, lambda c: c.rlike(textprep.PAGE_NUMBER), "12", "Page 12", "12 of 90", "12/90", "12.1", "LAW 12", "12.1 The bat")
    assert hits == [True] * 4 + [False] * 3


def test_repeated_lines_and_cleaning(spark):
    pages = spark.createDataFrame([("a", i, f"MCC LAWS\nline {i}\n{i}") for i in range(1, 4)] + [("b", 1, "only"), ("c", 1, None)], "doc_id string, page int, text string")
    assert {(r.doc_id, r.line) for r in textprep.repeated_lines(pages).collect()} == {("a", "MCC LAWS"), ("b", "only")}
    texts = {(r.doc_id, r.page): r.text for r in textprep.clean_pages(pages).collect()}
    assert texts[("a", 2)] == "line 2" and texts[("b", 1)] == "" and texts[("c", 1)] == ""


def test_segments(spark):
    pages = spark.createDataFrame([*PAGES, ("e", 1, ""), (None, 1, "x")], "doc_id string, page int, text string")
    got = {r.clause: r for r in segment.segment_documents(pages).collect()}
    assert got["1.1"].law_no == 1 and got["1.1"].clause_title == "Number of players"
    assert got["2.1"].clause_title == "Appointment of umpires" and "2.1.1" in got["2.1"].text and "2.1.1" not in got
    assert got["A.1"].law_no == -1 and "APPENDIX A" in got["A.1"].section_path
    assert "Some preamble text" in got["preamble"].text
    assert segment.segment_documents(pages.limit(0)).count() == 0


def test_decimals_in_prose_open_no_clause():
    lines = [(1, "LAW 4 THE BALL"), (1, "4.1 Weight"), (1, "not less than"), (1, "5.5 ounces/156 g and"), (1, "more")]
    (record,) = segment.segment_lines(lines)
    assert record["clause"] == "4.1" and "5.5 ounces" in record["text"]


@given(st.lists(st.integers(0, 9), max_size=12))
@settings(max_examples=50, deadline=None)
def test_rising_numbers_like_the_last_accepted(numbers):
    last, kept = None, []
    for n in numbers:
        if last is None or n > last:
            kept.append(n)
            last = n
    assert kept == [n for i, n in enumerate(numbers) if n > max(numbers[:i], default=-1)]


@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40))
@settings(max_examples=100, deadline=None)
def test_recursive_split_loses_nothing(text, size):
    pieces = chunking.split_recursive(text, size, 4)
    assert all(0 < len(p) <= size for p in pieces)
    rest = iter("".join(pieces).replace(" ", "").replace("\n", ""))
    assert all(c in rest for c in text.replace(" ", "").replace("\n", ""))


def test_build_chunks(spark):
    records = spark.createDataFrame([("d", 1, "1.1", "", "LAW 1 > 1.1", 1, 2, "body " * 400), ("x", 1, "1", "t", "p", 1, 1, "no source")], "doc_id string, law_no int, clause string, clause_title string, section_path string, page_start int, page_end int, text string")
    sources = spark.createDataFrame([("d", "Title", "mcc", "laws", None, "laws", "2026", None)], "doc_id string, title string, body string, competition string, gender string, doc_type string, effective_from string, status string")
    rows = chunking.build_chunks(records, sources).orderBy("chunk_index").collect()
    assert len(rows) == 2 and rows[0].text.startswith("[Title | Clause 1.1]\nbody") and rows[0].gender == "all" and rows[0].status == "active"
    assert rows[1].chunk_id == "d::1.1::1"


def test_passage_and_clause_number(spark):
    assert one(spark, passage, "[h]\nbody\nmore", "no line", "", None) == ["body\nmore", "", "", None]
    assert one(spark, clause_number, "6.2", "Clause 6.2", "cl. 06.2", "(6.2)", "6-2", " 6 . 2. ", "６.２", "A.1", "", None) == ["6.2"] * 7 + ["a.1", None, None]
