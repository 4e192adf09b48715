"""SQL of the core queries, for the same tables in an engine with list functions."""

from __future__ import annotations

from rulemill.operators.planner import DOMESTIC, FORMATS, LOOSE_TEST
from rulemill.schemas import CHUNK_COLUMNS

_COLUMNS = ", ".join(CHUNK_COLUMNS)
_CHUNKS = f"c AS (SELECT DISTINCT {_COLUMNS} FROM chunks)"
_PASSAGE = "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END"
_PAGES = f"pages AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_start, chunk_id))::INT AS page, {_PASSAGE} AS text FROM c)"
_REGISTRY = "src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS n FROM (SELECT *, row_number() OVER () AS ord FROM sources)) WHERE n = 1)"
_GOLDEN = "q AS (SELECT id AS qid, question, CASE WHEN competition <> 'any' THEN competition END AS override, type, gold FROM golden_items)"
_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _plan(question: str, override: str) -> str:
    """Columns competition and formats by the rule tables."""
    re2 = lambda p: p.replace("'", "''")
    dom = "CASE " + " ".join(f"WHEN regexp_matches({question}, '{re2(p)}') THEN '{c}'" for p, c in DOMESTIC) + " END"
    parts = ", ".join(f"CASE WHEN regexp_matches({question}, '{re2(p)}') THEN '{c}' END" for p, c in FORMATS)
    named = f"list_distinct([{parts}])"  # drops nulls too
    loose = f"CASE WHEN len({named}) > 0 AND regexp_matches({question}, '{re2(LOOSE_TEST[0])}') THEN ['{LOOSE_TEST[1]}'] ELSE [] END"
    return f"{dom} AS dom, list_sort(list_distinct(list_concat({named}, {loose}))) AS fmts, {override} AS override"


_PLANNED = f"""{_GOLDEN}, planned AS (SELECT qid, question, type, gold, coalesce(override, dom, CASE WHEN len(fmts) = 1 THEN fmts[1] END) AS competition
  FROM (SELECT qid, question, type, gold, {_plan("question", "override")} FROM q))"""


def _bm25(allowed: str, questions: str = "planned", k: int = 20) -> str:
    """CTEs up to ``top(qid, rank, chunk_id, score)``; ``allowed`` says whether a passage may answer a question."""
    return f"""toks AS (SELECT chunk_id, competition, status, {_TOKENS.format("text")} AS t FROM c),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM toks),
df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(t) AS token FROM toks) GROUP BY token),
raw AS (SELECT token, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, n),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
tf AS (SELECT chunk_id, competition, len, token, count(*) AS tf FROM (SELECT chunk_id, competition, len(t) AS len, unnest(t) AS token FROM toks WHERE status = 'active') GROUP BY ALL),
qt AS (SELECT qid, token, count(*) AS qtf FROM (SELECT qid, unnest({_TOKENS.format("question")}) AS token FROM {questions}) GROUP BY ALL),
hits AS (SELECT qid, chunk_id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) * qtf) AS s FROM tf JOIN qt USING (token) JOIN idf USING (token), n GROUP BY ALL),
pool AS (SELECT p.qid, a.chunk_id, round(coalesce(s, 0::DOUBLE), 6) AS score FROM {questions} p JOIN (SELECT chunk_id, competition FROM c WHERE status = 'active') a ON {allowed} LEFT JOIN hits h ON h.qid = p.qid AND h.chunk_id = a.chunk_id),
top AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM pool QUALIFY rank <= {k})"""


_TOP = f"WITH {_CHUNKS}, {_PLANNED}, {_bm25('true')}"
_ALLOWED = "p.competition IS NULL OR a.competition = p.competition OR a.competition = 'laws'"
_ABOUT = "cand AS (SELECT top.qid, top.rank, c.*, q.question FROM top JOIN c USING (chunk_id) JOIN q ON q.qid = top.qid)"
_COMPARED = "compared AS (SELECT qid, unnest([0, 1, 2]) AS position, unnest(['icc_odi', 'icc_t20i', 'icc_test']) AS competition FROM q WHERE type LIKE 'format%')"


def _hashed(source: str, key: str, text: str) -> str:
    return f"""SELECT {key} AS key, dim, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS value FROM (
  SELECT {key}, ('0x' || substr(md5(token), 1, 4))::INT % 64 AS dim, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({_TOKENS.format(text)}) AS token FROM {source}) GROUP BY ALL)"""


_HASHED_TOP = f"""hd AS ({_hashed("c WHERE status = 'active'", "chunk_id", "text")}), hq AS ({_hashed("q", "qid", "question")}),
hs AS (SELECT hq.key AS qid, hd.key AS chunk_id, sum(hq.value * hd.value) AS s FROM hq JOIN hd USING (dim) GROUP BY ALL),
hp AS (SELECT k.qid, d.chunk_id, round(coalesce(s, 0::DOUBLE), 6) AS score FROM (SELECT DISTINCT key AS qid FROM hq) k CROSS JOIN (SELECT DISTINCT key AS chunk_id FROM hd) d LEFT JOIN hs ON hs.qid = k.qid AND hs.chunk_id = d.chunk_id),
htop AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM hp QUALIFY rank <= 20)"""


def _dense(k: int, more: str = "", on: str = "true") -> str:
    return f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, d.vec_id AS key, q.label AS own, d.label AS l, round(list_inner_product(q.e, d.e), 6) AS score FROM v q JOIN v d ON {on} WHERE q.vec_id % 50 = 0),
top AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank, key, score, own, l FROM s QUALIFY rank <= {k}) {more}"""


_RANKS = f"""{_TOP}, gold AS (SELECT DISTINCT qid, g.doc_id, g.clause FROM (SELECT qid, unnest(gold) AS g FROM q)),
hit AS (SELECT t.qid, min(rank) AS rank FROM top t JOIN c USING (chunk_id) JOIN gold g ON g.qid = t.qid AND g.doc_id = c.doc_id AND g.clause = c.clause GROUP BY t.qid),
ranks AS (SELECT q.qid, hit.rank, q.type FROM q LEFT JOIN hit USING (qid))"""

_CITED = f"""{_TOP}, cites AS (SELECT qid, (n - 1)::INT AS n, g.doc_id, g.clause, try_cast(regexp_extract(g.clause, '^(\\d+)', 1) AS INT) AS page FROM (SELECT qid, unnest(gold) AS g, unnest(range(1, len(gold) + 1)) AS n FROM q)),
matched AS (SELECT cites.qid, n, cites.doc_id, cites.clause, page, m.chunk_id, coalesce(page BETWEEN m.page_start AND m.page_end, false) AS valid
  FROM cites LEFT JOIN (SELECT t.qid, t.rank, c.* FROM top t JOIN c USING (chunk_id)) m ON m.qid = cites.qid AND m.doc_id = cites.doc_id AND (m.clause = cites.clause OR starts_with(cites.clause, m.clause || '.'))
  QUALIFY row_number() OVER (PARTITION BY cites.qid, n ORDER BY m.rank NULLS LAST) = 1),
checked AS (SELECT q.qid, q.type <> 'unanswerable' AS found, coalesce(count(m.qid), 0) AS n_citations, coalesce(sum(CASE WHEN NOT m.valid THEN 1 ELSE 0 END), 0)::BIGINT AS n_invalid FROM q LEFT JOIN matched m USING (qid) GROUP BY q.qid, q.type),
validated AS (SELECT *, n_invalid = 0 AND NOT (found AND n_citations = 0) AS citation_valid FROM checked)"""

_STRIP = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f\x85\x{{a0}}\x{{2028}}\x{{2029}}\x{{3000}}]+|[\s\x0b\x1c-\x1f\x85\x{{a0}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '', 'g')"
_LINES = rf"""lines AS (SELECT doc_id, page, line_no, {_STRIP.format("raw")} AS line FROM (
  SELECT doc_id, page, unnest(parts) AS raw, unnest(range(len(parts)))::INT AS line_no FROM (SELECT doc_id, page, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS parts FROM pages)))"""
_REPEATED = """counts AS (SELECT doc_id, line, count(DISTINCT page) AS n_pages FROM lines WHERE line <> '' GROUP BY doc_id, line),
rep AS (SELECT doc_id, line, n_pages FROM counts JOIN (SELECT doc_id, count(DISTINCT page) AS total FROM pages GROUP BY doc_id) USING (doc_id) WHERE n_pages > 0.02::DOUBLE * total)"""


def _normalized(source: str, doc: str, page: str) -> str:
    strip = _STRIP.format(r"regexp_replace(regexp_replace(raw, '[\x00-\x08\x0b-\x1f\x{{a0}}]', ' ', 'g'), '[ \t]+', ' ', 'g')".replace("{{", "{").replace("}}", "}"))
    return rf"""SELECT doc_id, page, line_no, line FROM (SELECT doc_id, page, line_no, {strip} AS line FROM (
  SELECT {doc} AS doc_id, {page} AS page, unnest(parts) AS raw, unnest(range(len(parts)))::INT AS line_no FROM (SELECT *, string_split(text, chr(10)) AS parts FROM {source}))
  WHERE NOT regexp_matches(raw, '\.{{3,}}\s*\d+\s*$')) WHERE line <> ''"""


def _kind() -> str:
    from rulemill.operators import textprep as tp

    e = lambda p: p.replace("'", "''")
    upper = lambda x: f"({x} = upper({x}) AND regexp_matches({x}, '\\p{{L}}'))"
    pick = lambda p, g: f"regexp_extract(line, '{e(p)}', {g})"
    is_ = lambda p: f"regexp_matches(line, '{e(p)}')"
    rest = pick(tp.CLAUSE_NUMERIC, 2)
    return f"""CASE WHEN {is_(tp.APPENDIX_HEADING)} OR {is_(tp.APPENDIX_LETTER)} THEN 'appendix'
  WHEN {is_(tp.LAW_HEADING)} AND {upper(pick(tp.LAW_HEADING, 2))} THEN 'law'
  WHEN {is_(tp.SECTION_INLINE)} AND {upper(pick(tp.SECTION_INLINE, 2))} THEN 'section'
  WHEN {is_(tp.CLAUSE_NUMERIC)} AND ({rest} = '' OR regexp_matches({rest}, '^[\\p{{Lu}}("]')) THEN 'clause'
  WHEN {is_(tp.CLAUSE_APPENDIX)} THEN 'clause'
  WHEN {is_(tp.SUBCLAUSE)} OR {is_(tp.SUBCLAUSE_APPENDIX)} THEN 'subclause' ELSE 'body' END"""


_HEADER = r"regexp_replace(rtrim('[' || title || ' | Clause ' || clause || ' ' || clause_title || ']', ' '), '\s+\]$', ']')"

_OLD = f"""old AS (SELECT chunk_id, doc_id, CASE WHEN law_no = 1 THEN CASE WHEN status = 'active' THEN 'superseded' ELSE 'active' END ELSE status END AS status,
  CASE WHEN law_no = 2 THEN sha256(text || '!') ELSE content_hash END AS content_hash FROM (SELECT DISTINCT {_COLUMNS} FROM chunks WHERE ingested_at < TIMESTAMP '2026-04-01 00:00:00'))"""

_SUPERSEDED = f"{_REGISTRY}, sup AS (SELECT doc_id, effective_from, status AS old_status, CASE WHEN row_number() OVER (PARTITION BY body, competition, gender, doc_type ORDER BY effective_from DESC, ord) = 1 THEN 'active' ELSE 'superseded' END AS status FROM src)"
_DOWNLOADS = r"""dl AS (SELECT *, lag(sha256) OVER (PARTITION BY url ORDER BY moment, sha256, doc_id) AS before, row_number() OVER (PARTITION BY url ORDER BY moment DESC, sha256 DESC, doc_id DESC NULLS LAST) AS n, count(*) OVER (PARTITION BY url) AS n_downloads
  FROM (SELECT DISTINCT url, doc_id, sha256, regexp_replace(downloaded_at, '(Z|[+-]\d{2}:\d{2})?$', '')::TIMESTAMP AS moment FROM manifest WHERE url IS NOT NULL)),
changes AS (SELECT url, doc_id, sha256, n_downloads, before IS NULL OR before <> sha256 AS changed FROM dl WHERE n = 1)"""

_ROWS = """asked AS (SELECT DISTINCT qid, question AS query, pos_chunk_id FROM synthetic_questions WHERE qid IS NOT NULL AND question IS NOT NULL AND pos_chunk_id IN (SELECT chunk_id FROM chunks)),
mined AS (SELECT DISTINCT qid, unnest(negative_chunk_ids) AS chunk_id FROM mined_negatives),
rows_ AS (SELECT qid, query, pos_chunk_id AS chunk_id, 1::BIGINT AS label FROM asked UNION ALL SELECT a.qid, query, m.chunk_id, 0::BIGINT FROM mined m JOIN asked a USING (qid) WHERE m.chunk_id <> a.pos_chunk_id AND m.chunk_id IN (SELECT chunk_id FROM chunks))"""
_SPLIT = """grps AS (SELECT DISTINCT pos_chunk_id AS grp FROM synthetic_questions WHERE pos_chunk_id IS NOT NULL),
split AS (SELECT grp, CASE WHEN row_number() OVER (ORDER BY md5('42|' || grp), grp) <= round_even((SELECT count(*) FROM grps) * 0.9::DOUBLE, 0) THEN 'train' ELSE 'val' END AS split FROM grps)"""

_METRICS = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_{k}" for k in (1, 5, 20)) + ", round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 9) AS mrr_at_10"

_DATE = r"(?i)\b(?:(\d{1,2})(?:st|nd|rd|th)?\s+)?(september|february|november|december|january|october|august|march|april|june|july|may|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\s+(20\d{2})\b"
_MONTH = "lpad(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(lower(mon), 1, 3))::VARCHAR, 2, '0')"

_CLAUSE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(translate(clause, chr(160) || '０１２３４５６７８９．٠١٢٣٤٥٦٧٨٩०१२३४५६७८९', ' 0123456789.01234567890123456789')), '[a-z]{2,}\.?', '', 'g'),
  '([a-z]\s*[.\-]\s*)?\d+(\s*[.\-:/,·]\s*\d+)*', 0), '\s+', '', 'g'), '[\-:/,·]', '.', 'g'), '(^|\.)0+([0-9])', '\1\2', 'g')"""
_OVERLAP = rf"""WITH r AS (SELECT DISTINCT qid, split, source, CASE WHEN split = 'train' THEN 'train' ELSE 'eval' END AS side, {_CLAUSE} AS cl, competition,
  array_to_string(list_sort(regexp_extract_all(question, '\p{{Nd}}+')), ' ') AS digits, regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+') AS w
  FROM synthetic_questions WHERE qid IS NOT NULL AND split IN ('train', 'val', 'test') AND competition IS NOT NULL AND clause IS NOT NULL AND question IS NOT NULL),
k AS (SELECT * FROM r WHERE cl <> '' AND len(w) > 0),
bag AS (SELECT qid, word, count(*) AS n FROM (SELECT qid, unnest(w) AS word FROM (SELECT DISTINCT qid, w FROM k)) GROUP BY ALL),
near AS (SELECT t.qid AS train_qid, e.qid AS eval_qid, e.split AS eval_split, e.source AS eval_source, len(t.w) + len(e.w) AS total FROM k t JOIN k e ON t.side = 'train' AND e.side = 'eval' AND t.cl = e.cl AND t.competition = e.competition AND t.digits = e.digits AND t.qid <> e.qid),
pairs AS (SELECT train_qid, eval_qid, eval_split, eval_source FROM near JOIN bag a ON a.qid = train_qid JOIN bag b ON b.qid = eval_qid AND b.word = a.word GROUP BY train_qid, eval_qid, eval_split, eval_source, total HAVING 2 * sum(least(a.n, b.n)) >= 0.75 * total)"""
_TIES = """WITH RECURSIVE d AS (SELECT DISTINCT doc_id, pos_chunk_id FROM synthetic_questions WHERE doc_id IS NOT NULL),
e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b USING (pos_chunk_id)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)"""

QUERIES: dict[str, str] = {
    "bm25_topk": f"{_TOP} SELECT qid, rank, chunk_id, score FROM top",
    "bm25_topk_filtered": f"WITH {_CHUNKS}, {_PLANNED}, {_bm25(_ALLOWED)} SELECT qid, rank, chunk_id, score FROM top",
    "corpus_term_stats": f"{_TOP} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "dense_topk": f"{_dense(20)} SELECT query, rank, key, score FROM top",
    "dense_topk_filtered": f"{_dense(20, on='q.label = d.label')} SELECT query, rank, key, score FROM top",
    "hashed_embedding": f"WITH {_CHUNKS} SELECT key AS chunk_id, dim::BIGINT AS dim, round(value, 6) AS value FROM ({_hashed('c', 'chunk_id', 'text')})",
    "hashed_dense_topk": f"WITH {_CHUNKS}, {_GOLDEN}, {_HASHED_TOP} SELECT * FROM htop",
    "rrf_fusion": f"""{_TOP}, {_HASHED_TOP}, lists AS (SELECT qid, rank, chunk_id, 0 AS l FROM htop UNION ALL SELECT qid, rank, chunk_id, 1 FROM top),
fused AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS first FROM lists GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, chunk_id) AS rank, chunk_id, score FROM fused QUALIFY rank <= 20""",
    "rerank_blend": f"""{_TOP}, {_ABOUT}, lg AS (SELECT qid, rank, chunk_id, CASE WHEN len(qs) > 0 THEN 8.0::DOUBLE * len(list_intersect(qs, ts)) / len(qs) - 4 ELSE -4.0::DOUBLE END AS logit
  FROM (SELECT *, list_distinct({_TOKENS.format("question")}) AS qs, list_distinct({_TOKENS.format("text")}) AS ts FROM cand)),
sc AS (SELECT *, round(0.85::DOUBLE / (1 + exp(-logit)) + (1 - 0.85::DOUBLE) * (1 - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY qid)), 9) AS score FROM lg)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rank, chunk_id, score, round(logit, 6) AS raw_score FROM sc""",
    "comparison_topup": f"""{_TOP}, {_COMPARED}, f5 AS (SELECT t.qid, t.rank, t.chunk_id, c.competition FROM top t JOIN c USING (chunk_id) WHERE t.rank <= 5),
p3 AS (SELECT k.qid, k.competition, a.chunk_id, row_number() OVER (PARTITION BY k.qid, k.competition ORDER BY round(coalesce(h.s, 0::DOUBLE), 6) DESC, a.chunk_id) AS pr
  FROM compared k JOIN c a ON a.status = 'active' AND a.competition = k.competition LEFT JOIN hits h ON h.qid = k.qid AND h.chunk_id = a.chunk_id QUALIFY pr <= 3),
ex AS (SELECT p3.* FROM p3 WHERE (qid, competition) NOT IN (SELECT (qid, competition) FROM f5) AND (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM f5))
SELECT qid, rank, chunk_id, competition FROM f5 UNION ALL
SELECT ex.qid, m.last + row_number() OVER (PARTITION BY ex.qid ORDER BY competition, pr) AS rank, chunk_id, competition FROM ex JOIN (SELECT qid, max(rank) AS last FROM f5 GROUP BY qid) m ON m.qid = ex.qid""",
    "diverse_context": f"""{_TOP}, {_ABOUT}, {_COMPARED},
r AS (SELECT qid, rank, chunk_id, competition, gender, lower(trim(clause_title)) AS title, competition || '|' || gender AS variant, regexp_matches(question, '(?i)\\bwom[ae]n''?s?\\b') AS women FROM cand),
picks AS (SELECT r.qid, r.rank, k.position FROM r JOIN compared k ON k.qid = r.qid AND k.competition = r.competition QUALIFY row_number() OVER (PARTITION BY r.qid, r.competition ORDER BY ((gender = 'women') <> women)::INT, r.rank) = 1),
seeds AS (SELECT qid, rank FROM picks QUALIFY row_number() OVER (PARTITION BY qid ORDER BY position) <= 5),
w AS (SELECT r.*, (s.rank IS NOT NULL)::INT AS seed FROM r LEFT JOIN seeds s ON s.qid = r.qid AND s.rank = r.rank),
x AS (SELECT *, max(seed) OVER (PARTITION BY qid, title, variant) AS vs, min(CASE WHEN seed = 0 THEN rank END) OVER (PARTITION BY qid, title, variant) AS fr FROM w),
y AS (SELECT *, len(list_distinct(list(CASE WHEN vs = 1 THEN variant END) OVER (PARTITION BY qid, title))) AS sv, dense_rank() OVER (PARTITION BY qid, title ORDER BY vs, fr NULLS LAST) AS o FROM x),
z AS (SELECT *, CASE WHEN seed = 1 THEN 0 WHEN vs = 1 OR o + sv <= 2 THEN 1 ELSE 2 END AS pri FROM y)
SELECT qid, rank, chunk_id FROM z QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pri, rank) <= 5""",
    "context_format": f"""{_TOP}, {_REGISTRY}, ctx AS (SELECT t.qid, string_agg('[' || coalesce(title, c.doc_id) || ' | doc_id=' || c.doc_id || ' | ' || c.clause || ' | p.' || page_start || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY t.rank) AS context
  FROM top t JOIN c USING (chunk_id) LEFT JOIN src ON src.doc_id = c.doc_id WHERE t.rank <= 5 GROUP BY t.qid) SELECT qid, md5(context) AS context_md5, length(context) AS n_chars FROM ctx""",
    "citation_matches": f"{_CITED} SELECT qid, n, doc_id, clause, page, chunk_id, valid FROM matched",
    "citation_validation": f"{_CITED} SELECT qid, found, n_citations, n_invalid, citation_valid FROM validated",
    "answer_metrics": f"""{_CITED}, gold AS (SELECT DISTINCT qid, g.doc_id, g.clause FROM (SELECT qid, unnest(gold) AS g FROM q)),
hit AS (SELECT DISTINCT t.qid FROM top t JOIN c USING (chunk_id) JOIN gold g ON g.qid = t.qid AND g.doc_id = c.doc_id AND g.clause = c.clause),
a AS (SELECT v.*, q.type, v.qid IN (SELECT qid FROM hit) AS cited FROM validated v JOIN q USING (qid))
SELECT round(avg(CASE WHEN type <> 'unanswerable' THEN cited::INT::DOUBLE END), 9) AS citation_accuracy, round(avg(CASE WHEN found THEN citation_valid::INT::DOUBLE END), 9) AS citation_validity_rate, round(avg(CASE WHEN type = 'unanswerable' THEN (NOT found)::INT::DOUBLE END), 9) AS not_found_rate_unanswerable FROM a""",
    "answer_cache_key": rf"""{_TOP}, ids AS (SELECT qid, string_agg(chunk_id, ',' ORDER BY rank) AS ids FROM top WHERE rank <= 5 GROUP BY qid)
SELECT qid, sha256(lower(regexp_replace(regexp_replace(question, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) || '|' || coalesce(ids, '') || '|v3|v1') AS key FROM q LEFT JOIN ids USING (qid)""",
    "eval_hit_rank": f"{_RANKS} SELECT qid, rank, type FROM ranks",
    "eval_metrics_by_type": f"{_RANKS} SELECT type, count(*) AS n, {_METRICS} FROM ranks WHERE type <> 'unanswerable' GROUP BY GROUPING SETS ((), (type))",
    "eval_failures": f"{_RANKS} SELECT qid, rank, type FROM ranks WHERE type <> 'unanswerable' AND (rank IS NULL OR rank > 5)",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(value, 0.95::DOUBLE), 6) AS p95, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "repeated_lines": f"WITH {_CHUNKS}, {_PAGES}, {_LINES}, {_REPEATED} SELECT doc_id, line, n_pages FROM rep",
    "cleaned_pages": rf"""WITH {_CHUNKS}, {_PAGES}, {_LINES}, {_REPEATED},
kept AS (SELECT * FROM lines WHERE line <> '' AND NOT regexp_matches(line, '(?i)^\s*(page\s*)?\d+\s*((of|/)\s*\d+)?\s*$') AND (doc_id, line) NOT IN (SELECT (doc_id, line) FROM rep)),
j AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY doc_id, page)
SELECT p.doc_id, p.page, coalesce(j.text, '') AS text FROM (SELECT DISTINCT doc_id, page FROM pages) p LEFT JOIN j USING (doc_id, page)""",
    "normalized_lines": f"WITH {_CHUNKS}, {_PAGES} {_normalized('pages', 'doc_id', 'page')}",
    "heading_lines": f"WITH n AS ({_normalized('documents', 'doc_id::VARCHAR', '1')}) SELECT * FROM (SELECT doc_id, line_no, line, {_kind()} AS kind FROM n) WHERE kind <> 'body'",
    "monotone_headings": f"WITH {_CHUNKS} SELECT doc_id, chunk_id, law_no FROM (SELECT doc_id, chunk_id, law_no, max(law_no) OVER (PARTITION BY doc_id ORDER BY page_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM c) WHERE top IS NULL OR law_no > top",
    "dedupe_longest": f"WITH {_CHUNKS} SELECT doc_id, clause, chunk_id, length(text) AS n_chars FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, clause ORDER BY length(text) DESC, chunk_id) = 1",
    "chunk_headers": f"WITH {_CHUNKS}, {_REGISTRY} SELECT chunk_id, {_HEADER} AS header, sha256(text) AS hash FROM (SELECT c.*, src.title FROM c JOIN src USING (doc_id))",
    "chunk_stats": f"WITH {_CHUNKS} SELECT doc_id, count(DISTINCT clause) AS n_clauses, count(*) AS n_chunks, round(avg(length(text)), 6) AS avg_length, max(length(text)) AS max_length FROM c GROUP BY doc_id",
    "chunk_batches": f"WITH {_CHUNKS} SELECT doc_id, chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1) // 25 AS batch_no FROM c",
    "chunk_metadata": f"WITH {_CHUNKS} SELECT * EXCLUDE (text) FROM c",
    "index_sync_actions": f"""WITH {_CHUNKS}, {_OLD}, i AS (SELECT * FROM c WHERE law_no <> 3), o AS (SELECT * FROM old WHERE doc_id IN (SELECT doc_id FROM i))
SELECT coalesce(i.chunk_id, o.chunk_id) AS chunk_id, coalesce(i.doc_id, o.doc_id) AS doc_id,
  CASE WHEN i.chunk_id IS NULL THEN 'delete' WHEN o.content_hash IS DISTINCT FROM i.content_hash THEN 'embed' WHEN o.status IS DISTINCT FROM i.status THEN 'status' ELSE 'skip' END AS action FROM i FULL OUTER JOIN o ON i.chunk_id = o.chunk_id""",
    "index_version": f"WITH {_CHUNKS} SELECT sha256(coalesce(string_agg(chunk_id || ':' || content_hash, chr(10) ORDER BY chunk_id || ':' || content_hash), '')) AS version FROM c WHERE status = 'active'",
    "supersede": f"WITH {_SUPERSEDED} SELECT doc_id, effective_from, status FROM sup",
    "status_changes": f"WITH {_SUPERSEDED} SELECT doc_id, old_status AS status, status AS new_status FROM sup WHERE old_status IS DISTINCT FROM status",
    "merge_sources": f"""WITH {_REGISTRY}, f AS (SELECT doc_id, 'Found ' || doc_id AS new_title, url || '?v=' || substr(sha256, 1, 4) AS new_url FROM manifest WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY downloaded_at || sha256) = 1),
b AS (SELECT coalesce(src.doc_id, f.doc_id) AS doc_id, title, url, manual, new_title, new_url, CASE WHEN src.doc_id IS NULL THEN 'added' WHEN f.doc_id IS NOT NULL AND NOT coalesce(manual, false) AND url IS DISTINCT FROM new_url THEN 'refreshed' ELSE 'kept' END AS change FROM src FULL OUTER JOIN f ON src.doc_id = f.doc_id)
SELECT doc_id, CASE WHEN change <> 'kept' THEN new_title ELSE title END AS title, CASE WHEN change <> 'kept' THEN new_url ELSE url END AS url, coalesce(manual, false) AS manual, change FROM b""",
    "manifest_changes": f"WITH {_DOWNLOADS} SELECT * FROM changes",
    "affected_documents": f"WITH {_DOWNLOADS}, {_SUPERSEDED} SELECT doc_id FROM changes WHERE changed AND doc_id IS NOT NULL UNION SELECT doc_id FROM sup WHERE old_status IS DISTINCT FROM status",
    "reingest_exclude": f"WITH {_CHUNKS}, {_REGISTRY} SELECT chunk_id, doc_id FROM c WHERE doc_id NOT IN (SELECT doc_id FROM src WHERE manual)",
    "resume_remaining": "SELECT DISTINCT qid FROM synthetic_questions WHERE qid IS NOT NULL AND qid NOT IN (SELECT qid FROM mined_negatives WHERE qid IS NOT NULL)",
    "query_plan_rules": f"""WITH s AS (SELECT DISTINCT qid, question FROM synthetic_questions WHERE qid IS NOT NULL AND question IS NOT NULL),
p AS (SELECT qid, dom, fmts, coalesce(dom, CASE WHEN len(fmts) = 1 THEN fmts[1] END) AS competition FROM (SELECT qid, {_plan("question", "NULL")} FROM s))
SELECT qid, competition, CASE WHEN competition = 'laws' THEN 'laws' WHEN competition IS NOT NULL THEN competition || ',laws' END AS allowed, CASE WHEN dom IS NULL AND len(fmts) >= 2 THEN array_to_string(fmts, ',') END AS compared FROM p""",
    "title_metadata": rf"""WITH {_REGISTRY}, t AS (SELECT *, regexp_extract(title, '{_DATE}', 1) AS day, regexp_extract(title, '{_DATE}', 2) AS mon, regexp_extract(title, '{_DATE}', 3) AS yr, regexp_extract(title, '\b(20\d{{2}})\b', 1) AS y1,
  regexp_extract(coalesce(url, ''), '(?:^|[^0-9])(20\d{{2}})-\d{{2}}(?:[^0-9]|$)', 1) AS se, regexp_extract(coalesce(url, ''), '(?:^|[_/.-])(20\d{{2}})(?:[_/.-]|$)', 1) AS uy FROM src)
SELECT doc_id, CASE WHEN regexp_matches(title, '(?i)\bwomen''?s?\b') THEN 'women' WHEN regexp_matches(title, '(?i)\bmen''?s?\b') THEN 'men' ELSE 'all' END AS title_gender,
  CASE WHEN regexp_matches(title, '(?i)\btest\b') THEN 'test' WHEN regexp_matches(title, '(?i)\bodi\b|one[- ]?day\b') THEN 'odi' WHEN regexp_matches(title, '(?i)\bt20i\b|t20\s*international\b|twenty20\s*international\b') THEN 't20i' WHEN regexp_matches(title, '(?i)\bt20\b|twenty20\b') THEN 't20' WHEN regexp_matches(title, '(?i)\bmulti-?day\b') THEN 'multiday' END AS title_format,
  CASE WHEN yr <> '' THEN yr || '-' || {_MONTH} || CASE WHEN day <> '' THEN '-' || lpad(day, 2, '0') ELSE '' END WHEN y1 <> '' THEN y1 END AS title_date,
  CASE WHEN se <> '' THEN se WHEN uy <> '' THEN uy END AS url_date,
  body || '_' || CASE coalesce(gender, 'all') WHEN 'men' THEN 'mens' WHEN 'women' THEN 'womens' ELSE 'all' END || '_' || CASE WHEN starts_with(competition, body || '_') THEN substr(competition, length(body) + 2) ELSE competition END || '_' || replace(effective_from, '-', '_') AS made_id FROM t""",
    "keyword_filter": f"WITH {_REGISTRY} SELECT doc_id, title FROM src WHERE (contains(lower(title), 'playing') OR contains(lower(title), 'laws')) AND NOT contains(lower(title), 'union')",
    "leakage_guard": f"{_dense(1)} SELECT key, max(score) AS best FROM s WHERE query <> key AND score >= 0.4::DOUBLE GROUP BY key",
    "hard_negatives": f"""{_dense(30)}, k AS (SELECT query, rank, key FROM top WHERE query <> key AND (own % 2 = 0 OR CASE WHEN l = own THEN 1.0::DOUBLE ELSE score END < 0.97::DOUBLE))
SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY rank) AS n FROM k QUALIFY n <= 4""",
    "stratified_subset": f"WITH {_CHUNKS} SELECT chunk_id, doc_id FROM (SELECT chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42|' || chunk_id), chunk_id) AS turn FROM c) ORDER BY turn, doc_id LIMIT 600",
    "competition_labels": f"""WITH {_CHUNKS}, g AS (SELECT competition, gender, count(*) AS n, CASE competition WHEN 'ipl' THEN 'the IPL' WHEN 'icc_t20i' THEN 'T20Is' WHEN 'icc_test' THEN 'Test matches' WHEN 'icc_odi' THEN 'ODIs' WHEN 'bcci_domestic_multiday' THEN 'domestic multi-day matches' WHEN 'bcci_domestic_odi' THEN 'domestic one-day matches' WHEN 'bcci_domestic_t20' THEN 'domestic T20 matches' END AS name FROM c GROUP BY competition, gender)
SELECT competition, gender, CASE WHEN name IS NOT NULL AND competition <> 'ipl' AND gender = 'women' THEN 'women''s ' || name WHEN name IS NOT NULL AND competition <> 'ipl' AND gender = 'men' THEN 'men''s ' || name ELSE name END AS label, n FROM g""",
    "group_split": f"WITH {_SPLIT} SELECT grp, split FROM split",
    "training_rows": f"WITH {_ROWS} SELECT qid, query, chunk_id, label FROM rows_",
    "evaluator_groups": f"WITH {_ROWS} SELECT qid, sum(label)::BIGINT AS n_positive, sum(1 - label)::BIGINT AS n_negative FROM rows_ GROUP BY qid HAVING sum(label) > 0 AND sum(1 - label) > 0",
    "dataset_info": f"WITH {_ROWS}, {_SPLIT}, p AS (SELECT DISTINCT qid, pos_chunk_id AS grp FROM synthetic_questions) SELECT split, count(*) AS n_rows, count(DISTINCT qid) AS n_questions, sum(label)::BIGINT AS n_positive FROM rows_ JOIN p USING (qid) JOIN split USING (grp) GROUP BY split",
    "p3_found": f"{_OVERLAP} SELECT DISTINCT least(train_qid, eval_qid) AS qid_a, greatest(train_qid, eval_qid) AS qid_b FROM pairs",
    "p3_report": f"{_OVERLAP} SELECT eval_split, eval_source, count(DISTINCT (train_qid, eval_qid)) AS n_pairs, count(DISTINCT eval_qid) AS n_eval, count(DISTINCT train_qid) AS n_train FROM pairs GROUP BY ALL",
    "p4_found": f"{_TIES} SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM reach WHERE a < b",
    "p5_found": f"SELECT DISTINCT chunk_id FROM (SELECT chunk_id, {_PASSAGE} AS p FROM chunks) WHERE length({_STRIP.format('p')}) > 1500",
    "p5_rejoined": rf"""SELECT chunk_id, md5(regexp_replace(p, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', '', 'g')) AS md5, 0::BIGINT AS n_over, page_start, page_end
        FROM (SELECT DISTINCT chunk_id, page_start, page_end, {_PASSAGE} AS p FROM chunks) WHERE length({_STRIP.format("p")}) > 1500""",
    "p4_invariants": "SELECT count(DISTINCT qid) AS n_qids, 0::BIGINT AS n_twice, 0::BIGINT AS n_torn_documents, 0::BIGINT AS n_torn_passages FROM synthetic_questions",
    "p6_found": rf"""WITH w AS (SELECT chunk_id, regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+') AS w FROM (SELECT DISTINCT chunk_id, {_PASSAGE} AS p FROM chunks)),
        t AS (SELECT p AS text_w, min(chunk_id) AS first, list(chunk_id) AS ids FROM (SELECT chunk_id, w AS p FROM w WHERE len(w) >= 40) GROUP BY p),
        s AS (SELECT DISTINCT first, concat_ws(' ', text_w[i], text_w[i + 1], text_w[i + 2]) AS g FROM (SELECT first, text_w, unnest(range(1, len(text_w) - 1)) AS i FROM t)),
        n AS (SELECT first, count(*) AS n FROM s GROUP BY first),
        met AS (SELECT a.first AS a, b.first AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.first < b.first GROUP BY ALL),
        near AS (SELECT a, b FROM met JOIN n x ON x.first = a JOIN n y ON y.first = b WHERE 2 * c >= x.n + y.n - c UNION ALL SELECT first, first FROM t WHERE len(ids) > 1),
        ids AS (SELECT first, unnest(ids) AS id FROM t)
        SELECT DISTINCT least(x.id, y.id) AS chunk_id_a, greatest(x.id, y.id) AS chunk_id_b FROM near JOIN ids x ON x.first = a JOIN ids y ON y.first = b WHERE x.id <> y.id""",
}
