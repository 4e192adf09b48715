from pyspark.sql import functions as F

from rulemill.operators import discovery, indexing, training
from rulemill.schemas import CHUNK_COLUMNS, CHUNKS
from rulemill.sources import io
from rulemill.streaming.upsert import start_sync, stream_chunks, sync_batch

CHUNK = "chunk_id string, doc_id string, content_hash string, status string"


def actions(spark, new, old):
    rows = indexing.sync_actions(spark.createDataFrame(new, CHUNK), spark.createDataFrame(old, CHUNK)).collect()
    return {r.chunk_id: r.action for r in rows}


def test_sync(spark):
    a, b = ("a", "d", "h1", "active"), ("b", "d", "h2", "active")
    assert actions(spark, [a], []) == {"a": "embed"}
    assert actions(spark, [a], [a]) == {"a": "skip"}
    assert actions(spark, [("a", "d", "h9", "active")], [a]) == {"a": "embed"}
    assert actions(spark, [a], [a, b, ("x", "other", "h", "active")]) == {"a": "skip", "b": "delete"}
    assert actions(spark, [("a", "d", "h1", "superseded")], [a]) == {"a": "status"}


def test_version_of_nothing(spark):
    empty = spark.createDataFrame([], CHUNK)
    assert indexing.index_version(empty).first().version == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_supersede_and_merge(spark):
    rows = [("a", "2023-06", 0), ("b", "2025-06", 1), ("c", "2024-06", 2), ("d", "2025-06", 3)]
    src = spark.createDataFrame([(i, "icc", "odi", "men", "laws", e, o) for i, e, o in rows], "doc_id string, body string, competition string, gender string, doc_type string, effective_from string, ord bigint")
    assert {r.doc_id for r in indexing.apply_supersede(src).where("status = 'active'").collect()} == {"b"}
    have = spark.createDataFrame([("a", "A", "u", False), ("b", "B", "u", True)], "doc_id string, title string, url string, manual boolean")
    found = spark.createDataFrame([("a", "A2", "new", 0), ("b", "B2", "new", 1), ("c", "C", "c1", 2), ("c", "C", "c2", 3)], "doc_id string, title string, url string, ord bigint")
    got = {r.doc_id: (r.url, r.change) for r in indexing.merge_sources(have, found).collect()}
    assert got == {"a": ("new", "refreshed"), "b": ("u", "kept"), "c": ("c1", "added")}


def test_titles(spark):
    cases = {
        "ICC Women's Test Match playing Conditions - July 2026": ("women", "test", "2026-07"),
        "ICC Men's Test Match Playing Conditions - June 2025": ("men", "test", "2025-06"),
        "IPL 2026 Code of Conduct": ("all", None, "2026"),
        "Men's Twenty20 International Effective 1st January 2024": ("men", "t20i", "2024-01-01"),
    }
    t = F.col("t")
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", discovery.gender(t).alias("g"), discovery.format_of(t).alias("f"), discovery.effective_date(t).alias("d")).collect()
    assert {r.t: (r.g, r.f, r.d) for r in rows} == cases
    urls = {"/1772193467492_2025-26_BCCI_Men_PC.pdf": "2025", "/1775736835406_TATA_IPL_2026_x.pdf": "2026", "/120261234567_Some.pdf": None}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", discovery.url_date(F.col("u")).alias("d")).collect()
    assert {r.u: r.d for r in got} == urls
    made = spark.range(1).select(discovery.doc_id(F.lit("icc"), F.lit("women"), F.lit("icc_test"), F.lit("2026-07-01")).alias("x")).first().x
    assert made == "icc_womens_test_2026_07_01"


def test_links(spark):
    html = '<a href="/x.PDF"> Rules <b>2026</b></a><a href="/no.html">n</a><a href="/e.pdf"></a>'
    assert discovery.anchor_links(html) == [("Rules2026", "/x.PDF")]
    script = r'[{\"title\":\"Umpires \u0026 Scorers\",\"fileUrl\":\"https://files.example/u.pdf\"}, {"title":"Bad \x y","fileUrl":"https://files.example/b.pdf"}, {"title":"no","fileUrl":"http://x/c.pdf"}]'
    held = spark.createDataFrame([("s", script), ("long", '{"title":"' + "x" * 200_000), ("z", None)], "page_url string, html string")
    links = {(r.page_url, r.title, r.url) for r in discovery.extract_links(held, "bcci_embedded_json").collect()}
    assert links == {("s", "Umpires & Scorers", "https://files.example/u.pdf"), ("s", r"Bad \x y", "https://files.example/b.pdf")}
    first = spark.createDataFrame([("https://h.example/list/", '<a href="doc/one">One</a><a href="/doc/two">Two</a><a href="doc/one">again</a><a href="x">no</a>')], "page_url string, html string")
    assert {r.next_url for r in discovery.document_pages(first, "doc/").collect()} == {"https://h.example/list/doc/one", "https://h.example/doc/two"}
    second = spark.createDataFrame([("https://h.example/doc/two", '<a href="/t.pdf">Men\'s Test Conditions June 2025</a>')], "page_url string, html string")
    about = spark.createDataFrame([("https://h.example/list/", "icc_html", "icc", "icc", "pc", [], [])], "page_url string, parser string, body string, prefix string, doc_type string, include array<string>, exclude array<string>")
    assert [r.doc_id for r in discovery.discover_two_hops(first, second, about, "doc/").collect()] == ["icc_mens_test_2025_06"]
    pages = spark.createDataFrame([("p", html), ("z", None)], "page_url string, html string")
    assert [(r.title, r.url) for r in discovery.extract_links(pages, "icc_html").collect()] == [("Rules2026", "/x.PDF")]


def test_training_rows_and_split(spark):
    q = spark.createDataFrame([("q1", "a?", "c1"), ("q1", "a?", "c1"), ("q2", "b?", "gone"), ("q3", None, "c1")], "qid string, question string, pos_chunk_id string")
    n = spark.createDataFrame([("q1", ["c2", "c1", "gone", "c2"]), ("q2", ["c2"]), ("q9", None)], "qid string, negative_chunk_ids array<string>")
    c = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    rows = training.training_rows(q, n, c)
    assert sorted((r.qid, r.chunk_id, r.label) for r in rows.collect()) == [("q1", "c1", 1), ("q1", "c2", 0)]
    assert training.evaluator_groups(rows).first().n_negative == 1
    split = training.group_split(spark.range(100).select(F.col("id").cast("string").alias("grp")))
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 90, "val": 10}
    docs = spark.createDataFrame([(f"a{i}", "a") for i in range(10)] + [("b0", "b"), ("b1", "b")], "chunk_id string, doc_id string")
    assert {r.doc_id for r in training.stratified_subset(docs, 4).collect()} == {"a", "b"}


def test_io_round_trip(spark, tmp_path):
    row = ("d::1::0", "d", "b", "laws", "all", "laws", "2026", 1, "1", "t", "p", 1, 1, 0, "h", "active", "text")
    write = lambda r: io.write_chunks(spark.createDataFrame(r, CHUNKS), str(tmp_path / "chunks"))
    write([row, ("e::1::0", "e", *row[2:])])
    write([("d::1::0", *row[1:16], "other")])
    got = {r.doc_id: r.text for r in io.read_chunks(spark, str(tmp_path / "chunks")).collect()}
    assert got == {"d": "other", "e": "text"} and io.read_chunks(spark, str(tmp_path / "chunks"), ["e"]).count() == 1
    (tmp_path / "g.jsonl").write_text('{"id": "1", "question": "q", "competition": "any", "type": "lookup", "gold": [{"doc_id": "d", "clause": "1"}]}\n\n')
    assert io.read_golden(str(tmp_path / "g.jsonl"))[0]["gold"] == [("d", "1")]
    (tmp_path / "bad.jsonl").write_text("\n{")
    try:
        io.read_golden(str(tmp_path / "bad.jsonl"))
    except ValueError as e:
        assert "bad.jsonl:2" in str(e)
    assert io.read_version(str(tmp_path)) == "unversioned"
    io.write_version("abc", str(tmp_path))
    assert io.read_version(str(tmp_path)) == "abc"
    assert io.load_registry(spark, str(tmp_path / "none.yaml")).count() == 0
    src = spark.createDataFrame([("a", "1", 0), ("a", "2", 1)], "doc_id string, title string, ord bigint")
    assert io.last_of_each(src).first().title == "2"
    keys = spark.createDataFrame([("k", '{"a":1}', False), ("e", "{}", True)], "key string, answer_json string, error boolean")
    io.cache_put(keys, str(tmp_path / "cache"))
    hits = io.cache_get(spark.createDataFrame([("k",), ("e",)], "key string"), spark.read.parquet(str(tmp_path / "cache")))
    assert {r.key: r.answer_json for r in hits.collect()} == {"k": '{"a":1}', "e": None}


def test_stream(spark, tmp_path):
    """A late chunk leaves its document whole, a repeated batch changes nothing, a complete document drops what it lacks."""
    index, log = str(tmp_path / "index"), str(tmp_path / "log")

    def rows(*chunks, complete=None):
        made = [(f"{d}::{n}::0", d, "b", "laws", "all", "laws", "2026", 1, str(n), "t", "p", 1, 1, 0, h, "active", "text") for d, n, h in chunks]
        df = spark.createDataFrame(made, CHUNKS)
        return df if complete is None else df.withColumn("complete", F.lit(complete))

    def held():
        return sorted((r.chunk_id, r.content_hash) for r in io.read_chunks(spark, index).collect())

    def logged(n):
        return {r.chunk_id: r.action for r in spark.read.parquet(f"{log}/batch={n}").collect()}

    io.write_chunks(rows(("e", 0, "h"), ("e", 1, "h")), index)
    sync_batch(rows(("d", 0, "h"), ("d", 1, "h"), ("d", 2, "h")), index, log, 0)
    sync_batch(rows(("d", 3, "h")), index, log, 1)
    assert len(held()) == 6 and logged(1) == {"d::3::0": "embed"}
    before = held()
    sync_batch(rows(("d", 3, "h")), index, log, 1)
    assert held() == before and logged(1) == {"d::3::0": "embed"}
    sync_batch(rows(("d", 0, "h2"), ("d", 1, "h"), ("d", 1, "h"), complete=True), index, log, 2)
    assert logged(2) == {"d::0::0": "embed", "d::1::0": "skip", "d::2::0": "delete", "d::3::0": "delete"}
    assert held() == [("d::0::0", "h2"), ("d::1::0", "h"), ("e::0::0", "h"), ("e::1::0", "h")]
    sync_batch(rows(complete=True), index, log, 3)
    assert len(held()) == 4 and logged(3) == {}


def test_stream_of_files(spark, tmp_path):
    row = ("d::1::0", "d", "b", "laws", "all", "laws", "2026", 1, "1", "t", "p", 1, 1, 0, "h", "active", "text")
    index, log, ck, src = (str(tmp_path / n) for n in ("index", "log", "ck", "in"))
    spark.createDataFrame([row], CHUNKS).write.parquet(src)
    start_sync(stream_chunks(spark, src, CHUNKS), index, log, ck).awaitTermination()
    spark.createDataFrame([(row[0], *row[1:14], "h2", *row[15:])], CHUNKS).select(CHUNK_COLUMNS).write.mode("append").parquet(src)
    start_sync(stream_chunks(spark, src, CHUNKS), index, log, ck).awaitTermination()
    assert [(r.doc_id, r.content_hash) for r in io.read_chunks(spark, index).collect()] == [("d", "h2")]
    assert [r.action for r in spark.read.parquet(log).orderBy("batch").collect()] == ["embed", "embed"]


def test_generated_questions(spark):
    c = spark.createDataFrame([(f"d::{i}", "d", "icc_odi", "women", f"text {i}") for i in range(3)], "chunk_id string, doc_id string, competition string, gender string, text string")
    prompts = training.question_prompts(c, 2)
    assert prompts.count() == 2 and "[1] (women's ODIs) text 0" in prompts.orderBy("batch_no").first().prompt

    def provider(prompt):
        if "text 2" in prompt:
            raise RuntimeError("down")
        return {1: ["a?", "b?"]}

    got = [tuple(r) for r in training.generate_questions(prompts, provider, 2, 0.0).orderBy("qid").collect()]
    assert got == [("syn_d::0_1", "a?", "d::0"), ("syn_d::0_2", "b?", "d::0")]
