"""DuckDB SQL for the core queries: independent statements of the same results over the same tables."""

from __future__ import annotations

from tessella.functions import domain as dm
from tessella.functions import text as tx
from tessella.operators import retrieval as rt
from tessella.plans import queries as qs

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+"
KINDS = "('text', 'table', 'list', 'equation')"


def space(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def non_blank(x: str) -> str:
    return f"CASE WHEN {space(x)} <> '' THEN {x} END"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{TOKEN}'), lambda t: lower(t))"


def strip(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in tx.ENTITIES.items():
        out = f"replace({out}, '{name.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    return space(out)


def latest(table: str, key: str, version: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {version} DESC NULLS LAST) = 1)"


UNITS = latest("content_list", "unit_id", "loaded_at")
CHUNKS = latest("chunks", "id", "loaded_at")
META = latest("meta", "id", "loaded_at")
HITS = f"(SELECT * FROM {latest('hits', 'query_id, modal, index_dir, rid', 'run_at')} WHERE score_raw IS NOT NULL)"
TWO = f"(SELECT * FROM {HITS} WHERE modal IN ('faiss', 'bm25'))"
PAGE = "coalesce(page_idx, CASE WHEN regexp_matches(page, '^[0-9]+$') THEN CAST(page AS INT) END)"
ITEMS = f"array_to_string(list_filter(list_transform(items, lambda x: {space('x')}), lambda x: x <> ''), '；')"
PLAIN = space(f"coalesce({non_blank('text')}, {non_blank('content')}, '')")
UNIT_TEXT = f"CASE WHEN type = 'list' THEN coalesce(nullif({ITEMS}, ''), {PLAIN}) ELSE {PLAIN} END"
EVAL_TEXT = f"CASE WHEN type = 'list' THEN coalesce(array_to_string(list_transform(items, lambda x: {space('x')}), '；'), '') ELSE {space("coalesce(nullif(text, ''), nullif(table_text, ''), nullif(content, ''), '')")} END"
LINES = f"(SELECT doc_id, unnest(range(len(parts))) AS n, {space('unnest(parts)')} AS body FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS parts FROM documents))"
MODAL = "CASE modal WHEN 'faiss' THEN 0 WHEN 'bm25' THEN 1 ELSE 2 END"
YEAR = r"(?:19|20)\d{2}"
RANGE = rf"({YEAR})\s*[-~至到—－]\s*({YEAR})"
QUARTER = r"(?i)(?:Q[1-4]|[一二三四]季(?:度|报)?|第[一二三四]季度|[1-4]季报)"


def quarter(q: str) -> str:
    cases = " ".join(f"WHEN contains({q}, '{h}') OR contains({q}, '{k}') THEN 'Q{k}'" for k, h in enumerate("一二三四", 1))
    return f"CASE WHEN regexp_matches(upper({q}), '^Q[1-4]$') THEN upper({q}) {cases} END"


def years(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({t}, '{YEAR}'), lambda y: CAST(y AS INT)), lambda y: y BETWEEN 1900 AND 2100)"


def ranges(t: str, cap: int | None) -> str:
    a, b = (f"CAST(regexp_extract(m, '{RANGE}', {g}) AS INT)" for g in (1, 2))
    lo = f"least({a}, {b})" if cap is None else f"greatest(least({a}, {b}), greatest({a}, {b}) - {cap - 1})"
    return f"flatten(list_transform(regexp_extract_all({t}, '{RANGE}'), lambda m: list_transform(range({lo}, greatest({a}, {b}) + 1), lambda y: CAST(y AS INT))))"


def classify(t: str) -> tuple[str, str]:
    r, n = (" + ".join(f"CAST(contains({t}, '{w}') AS INT)" for w in words) for words in (dm.REPORT_WORDS, dm.NOTICE_WORDS))
    return r, n


def period(t: str, year: int) -> str:
    """A struct of the period of a question."""
    recent = f"CAST(nullif(regexp_extract({t}, '近\\s*([1-9]|1[0-9])\\s*年', 1), '') AS INT)"
    words = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
    names = {**words, "十": 10, **{f"十{k}": 10 + v for k, v in words.items()}, **{f"一十{k}": 10 + v for k, v in words.items()}, "一十": 10}
    s = f"replace(trim(regexp_extract({t}, '近([ 一二两三四五六七八九十]+)年', 1)), ' ', '')"
    han = f"CASE {s} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items()) + " END"
    back = lambda n: f"coalesce(list_transform(range({n}), lambda i: CAST({year} - i AS INT)), [])"
    rel = " || ".join(f"(CASE WHEN contains({t}, '{w}') THEN [{year - k}] ELSE [] END)" for w, k in (("去年", 1), ("前年", 2), ("今年", 0)))
    every = f"{years(t)} || {ranges(t, dm.RANGE_CAP)} || {back(recent)} || {back(han)} || {rel}"
    qs = f"list_transform(regexp_extract_all({t}, '{QUARTER}'), lambda q: {quarter('q')})"
    return f"""array_to_string(list_sort(list_distinct(list_filter({every}, lambda y: y BETWEEN 1900 AND 2100))), ',') AS years,
        array_to_string(list_filter({qs}, lambda q, i: list_position({qs}, q) = i), ',') AS quarters,
        regexp_matches({t}, '{RANGE}') AS is_range, coalesce({han}, {recent}) AS n_recent, regexp_matches({t}, '去年|前年|今年') AS has_relative"""


def title() -> str:
    r, n = classify("t")
    reports = "|".join(dm.REPORT_TITLES)
    return rf"""WITH a AS (SELECT DISTINCT doc_id, regexp_replace(doc_id, '^\d{{4}}-\d{{2}}-\d{{2}}\s+', '') AS t, CASE WHEN regexp_matches(doc_id, '^\d{{4}}-\d{{2}}-\d{{2}}\s+') THEN doc_id[1:10] END AS source_date FROM doc_registry),
        b AS (SELECT *, CAST(source_date[1:4] AS INT) AS prefix, {ranges('t', None)} || {years('t')} AS ys, {r} AS r, {n} AS n, nullif(regexp_extract(t, '{QUARTER}'), '') AS q FROM a)
        SELECT doc_id, CASE WHEN contains(t, '公告') THEN 'notice' WHEN r > n THEN 'report' WHEN n > r THEN 'notice' WHEN regexp_matches(t, '{reports}') THEN 'report' END AS doc_type,
        CASE WHEN len(ys) > 0 THEN ys[len(ys)] ELSE prefix END AS year, {quarter('q')} AS quarter, source_date, CASE WHEN len(ys) > 0 THEN 'title' WHEN prefix IS NOT NULL THEN 'prefix' END AS year_source,
        array_to_string(list_sort(list_distinct(list_filter(ys || [prefix], lambda y: y IS NOT NULL))), ',') AS years_mentioned, len(list_distinct(ys)) > 1 AS is_multi_year FROM b"""


PACK = f"""WITH RECURSIVE u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, body FROM {LINES} WHERE body <> ''),
    f AS (SELECT doc_id, i, CAST(1 AS BIGINT) AS no, CAST(length(body) AS BIGINT) AS size, length(body) > 500 AS alone FROM u WHERE i = 1
        UNION ALL SELECT u.doc_id, u.i, CASE WHEN f.alone OR length(u.body) > 500 OR f.size + 1 + length(u.body) > 500 THEN f.no + 1 ELSE f.no END,
            CASE WHEN f.alone OR length(u.body) > 500 OR f.size + 1 + length(u.body) > 500 THEN length(u.body) ELSE f.size + 1 + length(u.body) END, length(u.body) > 500
        FROM f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1)
    SELECT doc_id, CAST(no AS INT) AS no, length(string_agg(body, chr(10) ORDER BY i)) AS n, md5(string_agg(body, chr(10) ORDER BY i)) AS hash FROM f JOIN u USING (doc_id, i) GROUP BY doc_id, no"""

ROWS = f"""WITH RECURSIVE k AS (SELECT *, {PAGE} AS p, CASE WHEN type = 'table' THEN coalesce(table_text, '') ELSE {UNIT_TEXT} END AS body, CAST(sum(CASE WHEN type = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY unit_no) AS INT) AS seq
        FROM {UNITS} WHERE type IN {KINDS}),
    u AS (SELECT doc_id, seq, p, body, row_number() OVER (PARTITION BY doc_id, seq ORDER BY unit_no) AS i FROM k WHERE type <> 'table' AND body <> ''),
    f AS (SELECT doc_id, seq, i, CAST(0 AS BIGINT) AS no, CAST(length(body) AS BIGINT) AS size, length(body) > 500 AS alone FROM u WHERE i = 1
        UNION ALL SELECT u.doc_id, u.seq, u.i, CASE WHEN f.alone OR length(u.body) > 500 OR f.size + 1 + length(u.body) > 500 THEN f.no + 1 ELSE f.no END,
            CASE WHEN f.alone OR length(u.body) > 500 OR f.size + 1 + length(u.body) > 500 THEN length(u.body) ELSE f.size + 1 + length(u.body) END, length(u.body) > 500
        FROM f JOIN u ON u.doc_id = f.doc_id AND u.seq = f.seq AND u.i = f.i + 1),
    t AS (SELECT doc_id, 2 * seq + 1 AS place, no AS sub, 'text' AS type, arg_min(p, i) FILTER (p IS NOT NULL) AS page, string_agg(body, chr(10) ORDER BY i) AS content, CAST(NULL AS INT) AS s, CAST(NULL AS INT) AS r, CAST(NULL AS VARCHAR) AS digest FROM f JOIN u USING (doc_id, seq, i) GROUP BY doc_id, seq, no),
    l AS (SELECT doc_id, seq, p, sha1({space('body')}) AS digest, list_filter(list_transform(string_split(body, chr(10)), lambda x: {space('x')}), lambda x: x <> '') AS parts FROM k WHERE type = 'table'),
    r AS (SELECT doc_id, 2 * seq AS place, unnest(range(len(parts))) AS sub, 'table_row' AS type, p AS page, unnest(parts) AS content, seq AS s, CAST(unnest(range(1, len(parts) + 1)) AS INT) AS r, digest FROM l),
    a AS (SELECT * FROM t UNION ALL SELECT * FROM r),
    b AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, sub) AS INT) AS ord, CAST(sum(CASE WHEN type = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place, sub) AS INT) AS idx FROM a)
    SELECT doc_id || coalesce('#p' || page, '') || CASE WHEN type = 'text' THEN '#c' || idx ELSE '#t' || s || '#r' || r END AS id, doc_id, type, page, content, ord, CASE WHEN s IS NOT NULL THEN doc_id || coalesce('::p' || page, '') || '::t' || s END AS table_id, s AS seq, r AS row_index, digest FROM b"""

HTML = ROWS[: ROWS.index("    l AS (")].replace("coalesce(table_text, '')", "coalesce(table_body, '')").replace("CAST(NULL AS VARCHAR) AS digest", "CAST(NULL AS INT) AS n") + f"""    l AS (SELECT doc_id, seq, p, CASE WHEN {space('body')} = '' THEN [] WHEN length(body) <= 4000 THEN [body] ELSE [body[1:length(body) // 2], body[length(body) // 2 + 1:]] END AS parts FROM k WHERE type = 'table'),
    r AS (SELECT doc_id, 2 * seq AS place, unnest(range(len(parts))) AS sub, 'table' AS type, p AS page, unnest(parts) AS content, seq AS s, CAST(unnest(range(1, len(parts) + 1)) AS INT) AS r, CAST(len(parts) AS INT) AS n FROM l),
    a AS (SELECT * FROM t UNION ALL SELECT * FROM r), b AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, sub) AS INT) AS ord FROM a)
    SELECT doc_id || coalesce('#p' || page, '') || '#c' || ord AS id, doc_id, type, page, content, ord, CASE WHEN s IS NOT NULL THEN doc_id || coalesce('::p' || page, '') || '::t' || s END AS table_id, s AS seq, r AS part, n AS parts FROM b"""

#: Units of the chunking evaluation, oversize ones cut: each part is a chunk of its own.
LEVEL = f"""WITH RECURSIVE e AS (SELECT doc_id, unit_no, {EVAL_TEXT} AS body, text_level IS NOT NULL AS brk FROM {UNITS} WHERE type IN {KINDS}),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS i FROM e WHERE body <> ''),
    f AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS no, CAST(length(body) AS BIGINT) AS size, length(body) > 800 AS alone FROM u WHERE i = 1
        UNION ALL SELECT u.doc_id, u.i, CASE WHEN f.alone OR length(u.body) > 800 OR u.brk OR f.size + length(u.body) > 800 THEN f.no + 1 ELSE f.no END,
            CASE WHEN f.alone OR length(u.body) > 800 OR u.brk OR f.size + length(u.body) > 800 THEN length(u.body) ELSE f.size + length(u.body) END, length(u.body) > 800
        FROM f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1),
    g AS (SELECT doc_id, no, bool_or(alone) AS alone, string_agg(body, chr(10) ORDER BY i) AS body FROM f JOIN u USING (doc_id, i) GROUP BY doc_id, no),
    p AS (SELECT doc_id, no, unnest(CASE WHEN alone THEN list_transform(range(0, length(body), 800), lambda b: body[b + 1:b + 800]) ELSE [body] END) AS body, unnest(range(CASE WHEN alone THEN CAST(ceil(length(body) / 800.0) AS BIGINT) ELSE 1 END)) AS k FROM g)
    SELECT concat(doc_id, '_', row_number() OVER (PARTITION BY doc_id ORDER BY no, k) - 1) AS id, length(body) AS n, md5(body) AS hash FROM p"""

BM25 = f"""t AS (SELECT source AS idx, doc_id AS rid, {tokens('text')} AS toks FROM documents WHERE source IS NOT NULL),
    stats AS (SELECT idx, count(*) AS n, avg(len(toks)) AS avgdl FROM t GROUP BY idx),
    post AS (SELECT idx, rid, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT idx, rid, len(toks) AS dl, unnest(toks) AS term FROM t) GROUP BY idx, rid, term),
    raw AS (SELECT idx, term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post JOIN stats USING (idx) GROUP BY idx, term),
    terms AS (SELECT idx, term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY idx) ELSE raw END AS idf FROM raw)"""

DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
UNIT = "(SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y * y))) + 1e-12)) AS v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"


def scaled(strict: bool) -> str:
    how = "CASE WHEN hi - lo < 1e-12 THEN 0.0 ELSE (score_raw - lo) / (hi - lo) END" if strict else "(score_raw - lo) / (hi - lo + 1e-12)"
    return f"(SELECT * EXCLUDE (lo, hi), {how} AS norm FROM (SELECT *, min(score_raw) OVER (PARTITION BY query_id, modal) AS lo, max(score_raw) OVER (PARTITION BY query_id, modal) AS hi FROM {TWO}))"


BLENDED = f"(SELECT *, 0.5 * norm AS score_blend, CASE WHEN rid % 3 = 0 THEN concat(regexp_replace(index_dir, '^[^/]*/', ''), '::t1') END AS table_id FROM {scaled(True)})"
PRUNED = f"""a AS (SELECT *, row_number() OVER (PARTITION BY query_id, table_id ORDER BY round(score_blend, 9) DESC, {MODAL}, index_dir, rid) AS k FROM {BLENDED}),
    b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score_blend, 9) DESC, {MODAL}, index_dir, rid) AS INT) AS pre_rank FROM a WHERE k = 1 OR table_id IS NULL QUALIFY pre_rank <= 30),
    c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY pre_rank) = 1)"""
PLACED = f"""{PRUNED}, m AS (SELECT id, coalesce(nullif(raw_content, ''), nullif(embed_text, ''), '') AS content, page, type, doc_id FROM {META}),
    d AS (SELECT c.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pre_rank) - 1 AS INT) AS position FROM c),
    e AS (SELECT d.query_id, d.id, d.position, d.table_id, d.modal, d.index_dir, m.content, m.page, m.type, m.doc_id, query_text FROM d JOIN m ON m.id = d.id JOIN queries q ON q.query_id = d.query_id)"""
FALLBACK = f"""{PLACED}, r AS (SELECT *, CAST(count(*) OVER (PARTITION BY query_id) - position AS DOUBLE) AS rerank_score FROM e),
    s AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, position) AS INT) AS rerank_rank FROM r QUALIFY rerank_rank <= 10)"""


def rrf(key: str) -> str:
    return f"""WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, modal ORDER BY round(score_raw, 9) DESC, index_dir, rid) AS INT) AS rank FROM {TWO}),
        g AS (SELECT query_id, {key}, min(rank) FILTER (modal = 'faiss') AS faiss_rank, min(rank) FILTER (modal = 'bm25') AS bm25_rank FROM r GROUP BY ALL)
        SELECT query_id, {key}, faiss_rank, bm25_rank, round(coalesce(0.5 / (60 + faiss_rank), 0) + coalesce(0.5 / (60 + bm25_rank), 0), 9) AS score_rrf FROM g"""


CHUNK_ROWS = f"r AS (SELECT id, source AS index_dir, doc_id, ord, tbl.id AS table_id, tbl.row_index AS row_index, coalesce(content, '') AS content FROM {CHUNKS}), h AS (SELECT * FROM r WHERE CAST('0x' || right(md5(id), 6) AS BIGINT) % 100 = 0)"
RESTORED = """b AS (SELECT h.id AS hit_id, h.index_dir, h.doc_id, CASE WHEN h.table_id IS NOT NULL AND h.ord IS NOT NULL THEN string_agg(r.content, chr(10) ORDER BY coalesce(r.row_index, 999999), coalesce(r.ord, 999999)) FILTER (r.content <> '') ELSE any_value(h.content) END AS base,
    coalesce(min(r.ord), any_value(h.ord)) AS lo, coalesce(max(r.ord), any_value(h.ord)) AS hi FROM h LEFT JOIN r ON r.index_dir = h.index_dir AND r.table_id = h.table_id GROUP BY h.id, h.index_dir, h.doc_id, h.table_id, h.ord)"""


def latest_docs() -> str:
    return f"(SELECT doc_id, doc_type, year, quarter, source_date FROM {latest('doc_registry', 'doc_id', 'loaded_at')})"


FIRST = f"(SELECT index_dir, arg_min(doc_id, rid) AS doc_id, arg_min(doc_meta, rid) AS m FROM {META} GROUP BY index_dir)"


def registry() -> str:
    return f"""nm AS ({title().replace("FROM doc_registry)", f"FROM {FIRST})")}),
        reg AS (SELECT f.doc_id, m.doc_type AS doc_type, coalesce(m.year, nm.year) AS year, coalesce(m.quarter, nm.quarter) AS quarter, m.source_date AS source_date FROM {FIRST} f LEFT JOIN nm ON nm.doc_id = f.doc_id)"""


ROUTES = f"""docs AS (SELECT doc_id, doc_type, year, coalesce(CAST(year AS VARCHAR), 'unknown') AS y FROM {latest_docs()}),
    dense AS (SELECT 'faiss' AS kind, concat('faiss_ctrl/', doc_id) AS index_dir, doc_type, y FROM docs),
    sparse AS (SELECT 'bm25' AS kind, concat('bm25_ctrl/', doc_id) AS index_dir, doc_type, y FROM docs WHERE year IS NULL OR year % 2 = 0)"""


def routed(dense: str, sparse: str) -> str:
    return f"WITH {ROUTES} SELECT kind, index_dir FROM dense WHERE {dense} UNION SELECT kind, index_dir FROM sparse WHERE {sparse}"


def sparse_of(kind: str, ys: list[int]) -> str:
    listed = ", ".join(f"'{y}'" for y in ys) or "''"
    return f"(doc_type = '{kind}' AND (y IN ({listed}) OR (y = 'unknown' AND NOT EXISTS (SELECT 1 FROM sparse s WHERE s.doc_type = '{kind}' AND s.y IN ({listed})))))"


def registry_of(first: str, name: str) -> str:
    """CTEs with the document registry `name` of first rows (doc_id, m)."""
    return f"""nm_{name} AS ({title().replace("FROM doc_registry)", f"FROM {first})")}),
        {name} AS (SELECT DISTINCT f.doc_id, m.doc_type AS doc_type, coalesce(m.year, nm.year) AS year, coalesce(m.quarter, nm.quarter) AS quarter, m.source_date AS source_date FROM {first} f LEFT JOIN nm_{name} nm ON nm.doc_id = f.doc_id)"""


CHUNK_FIRST = f"(SELECT doc_id, arg_min(meta, ord) AS m FROM {CHUNKS} GROUP BY doc_id)"


def built() -> str:
    known = ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in ("doc_type", "year", "quarter", "source_date"))
    return f"""{registry_of(FIRST, 'a')}, {registry_of(CHUNK_FIRST, 'b')}, later AS (SELECT b.doc_id, {known} FROM b LEFT JOIN a USING (doc_id)),
        docs AS (SELECT * FROM later UNION ALL SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM later))"""


#: Chunks by length with overlap: b is the last unit from which the units before i reach the overlap.
LENGTH = f"""WITH RECURSIVE u AS (SELECT doc_id, body, length(body) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, sum(length(body)) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM {LINES} WHERE body <> ''),
    b AS (SELECT a.doc_id, a.i, any_value(a.len) AS len, any_value(a.p) AS p, max(c.i) FILTER (a.p - a.len - c.p + c.len >= 200) AS b FROM u a LEFT JOIN u c ON c.doc_id = a.doc_id AND c.i < a.i GROUP BY a.doc_id, a.i),
    f AS (SELECT doc_id, i, CASE WHEN len > 800 THEN 2 ELSE 1 END AS start, CASE WHEN len > 800 THEN 0 ELSE len END AS size, CAST(NULL AS BIGINT) AS first FROM b WHERE i = 1
        UNION ALL SELECT b.doc_id, b.i, CASE WHEN len > 800 THEN b.i + 1 WHEN size + len > 800 THEN greatest(start, coalesce(b.b, start)) ELSE start END,
            CASE WHEN len > 800 THEN 0 WHEN size + len > 800 THEN len + p - len - coalesce((SELECT x.p - x.len FROM u x WHERE x.doc_id = b.doc_id AND x.i = greatest(start, coalesce(b.b, start))), 0) ELSE size + len END,
            CASE WHEN size > 0 AND (len > 800 OR size + len > 800) THEN start END FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1),
    e AS (SELECT doc_id, first AS a, i - 1 AS z, i AS place FROM f WHERE first IS NOT NULL
        UNION ALL SELECT doc_id, start, i, i + 1 FROM f WHERE start <= i AND NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = f.doc_id AND u.i = f.i + 1)),
    c AS (SELECT e.doc_id, e.place, CAST(0 AS BIGINT) AS sub, string_agg(u.body, chr(10) ORDER BY u.i) AS body FROM e JOIN u ON u.doc_id = e.doc_id AND u.i BETWEEN e.a AND e.z GROUP BY e.doc_id, e.place
        UNION ALL SELECT doc_id, i, unnest(range(1, CAST(ceil(len / 800.0) AS BIGINT) + 1)), unnest(list_transform(range(0, len, 800), lambda x: body[x + 1:x + 800])) FROM u WHERE len > 800)
    SELECT concat(doc_id, '_', row_number() OVER (PARTITION BY doc_id ORDER BY place, sub) - 1) AS id, length(body) AS n, md5(body) AS hash FROM c"""

#: Breaks of the semantic strategy: counts of hashed characters in 16 slots as vectors, the cosine to the unit before.
SEMANTIC = LEVEL.replace(
    "f AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS no",
    """ch AS (SELECT doc_id, i, unnest(regexp_extract_all(body, '(?s).')) AS c FROM u),
    sl AS (SELECT doc_id, i, (CAST(unicode(c) AS HUGEINT) * 11400714819323198485 % 18446744073709551616) // 1099511627776 % 16 AS slot, count(*) AS k FROM ch WHERE c <> ' ' GROUP BY ALL),
    nm AS (SELECT doc_id, i, sqrt(sum(k * k)) AS norm FROM sl GROUP BY ALL),
    dp AS (SELECT x.doc_id, x.i, sum(x.k * y.k) AS dot FROM sl x JOIN sl y ON y.doc_id = x.doc_id AND y.i = x.i - 1 AND y.slot = x.slot GROUP BY ALL),
    v AS (SELECT u.* EXCLUDE (brk), u.i > 1 AND coalesce(dot, 0) / (a.norm * b.norm) < 0.6 AS brk FROM u LEFT JOIN nm a ON a.doc_id = u.doc_id AND a.i = u.i LEFT JOIN nm b ON b.doc_id = u.doc_id AND b.i = u.i - 1 LEFT JOIN dp ON dp.doc_id = u.doc_id AND dp.i = u.i),
    f AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS no""",
).replace("FROM f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1", "FROM f JOIN v AS u ON u.doc_id = f.doc_id AND u.i = f.i + 1")

OVERRIDE = "CASE WHEN contains(query_text, '公告') THEN 'notice' WHEN contains(query_text, '年') AND doc_type IS NULL THEN 'both' END"


def batch() -> str:
    """CTEs with `routed`: what every question is to be searched in."""
    return f"""{ROUTES}, p AS (SELECT query_id, {period('query_text', 2024)} FROM queries),
    q AS (SELECT query_id, {OVERRIDE} AS o, doc_type, CASE WHEN p.years = '' THEN [] ELSE string_split(p.years, ',') END AS ys FROM queries JOIN p USING (query_id)),
    k AS (SELECT *, CASE WHEN o = 'notice' THEN o WHEN o = 'both' THEN NULL ELSE doc_type END AS t FROM q),
    db AS (SELECT DISTINCT doc_type, y FROM dense WHERE doc_type IS NOT NULL), sb AS (SELECT DISTINCT doc_type, y FROM sparse WHERE doc_type IS NOT NULL),
    d AS (SELECT DISTINCT query_id, db.doc_type, db.y FROM (SELECT query_id, t, unnest(ys) AS y FROM k) a JOIN db USING (y) WHERE t IS NULL OR t = db.doc_type OR t NOT IN (SELECT doc_type FROM db)),
    s0 AS (SELECT query_id, ys, unnest(CASE WHEN t IS NOT NULL THEN [t] WHEN len(ys) > 0 OR o = 'both' THEN ['report', 'notice'] ELSE [] END) AS doc_type FROM k),
    s1 AS (SELECT DISTINCT query_id, doc_type, sb.y FROM (SELECT query_id, doc_type, unnest(ys) AS y FROM s0) a JOIN sb USING (doc_type, y)),
    s AS (SELECT * FROM s1 UNION SELECT query_id, doc_type, sb.y FROM s0 JOIN sb USING (doc_type) WHERE sb.y = 'unknown' AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.query_id = s0.query_id AND s1.doc_type = s0.doc_type)),
    r AS (SELECT query_id, 'faiss' AS kind, 'buckets' AS scope, doc_type, y AS year_key FROM d UNION ALL SELECT query_id, 'faiss', 'named', NULL, NULL FROM k WHERE len(ys) > 0 AND query_id NOT IN (SELECT query_id FROM d) UNION ALL SELECT query_id, 'bm25', 'buckets', doc_type, y FROM s),
    routed AS (SELECT * FROM r UNION ALL SELECT query_id, unnest(['faiss', 'bm25']), 'all', NULL, NULL FROM k WHERE query_id NOT IN (SELECT query_id FROM r))"""


def material(limit: str) -> str:
    """CTEs with `y`: the context of every question, cut where it is longer than `limit` leaves room."""
    return f"""{FALLBACK}, l AS (SELECT query_id, any_value(query_text) AS q, string_agg('[' || rerank_rank || '] doc=' || coalesce(doc_id, '') || ' page=' || coalesce(CAST(page AS VARCHAR), 'None') || ' type=' || coalesce(type, '') || chr(10)
            || CASE WHEN table_id IS NULL AND length(content) > 120 THEN content[1:120] || '…' ELSE content END, chr(10) || chr(10) ORDER BY rerank_rank) AS x FROM s GROUP BY query_id),
            h AS (SELECT q.query_id, q.query_text AS q, coalesce(x, '') AS x, greatest(0, {limit} - length(q.query_text)) AS room FROM queries q LEFT JOIN l USING (query_id)),
            y AS (SELECT query_id, q, CASE WHEN length(x) > room THEN x[1:greatest(0, room - 100)] || '{rt.CUT_NOTICE}' ELSE x END AS x FROM h)"""


def oracle_sql() -> dict[str, str]:
    start, between, end = rt.ANSWER_PROMPT
    fixed = len(qs.SYSTEM) + sum(map(len, rt.ANSWER_PROMPT))
    r, n = classify("body")
    order = "近' || (o_orderkey % 22) || '年' || (year(o_orderdate) - 12) || '至' || year(o_orderdate) || '年第三季度与去年"
    return {
        "normalize_space": f"SELECT doc_id, length({space('text')}) AS n, md5({space('text')}) AS hash FROM documents",
        "bm25_tokenize": f"SELECT doc_id, len({tokens('text')}) AS n, md5(array_to_string({tokens('text')}, ' ')) AS hash FROM documents",
        "strip_html": f"SELECT id, {strip('raw_content')} AS plain FROM {META}",
        "merged_cell_flag": f"""SELECT unit_id, len(list_filter(regexp_extract_all(table_body, '(?i)\\b(?:colspan|rowspan)\\s*=\\s*["'']?\\s*(\\d+)', 1), lambda x: CAST(x AS BIGINT) > 1)) > 0 AS merged FROM {UNITS} WHERE table_body IS NOT NULL""",
        "content_fallback": f"SELECT id, length(coalesce(nullif(embed_text, ''), nullif(raw_content, ''), '')) AS n FROM {META}",
        "unit_text": f"SELECT unit_id, {PAGE} AS page_no, {UNIT_TEXT} AS body FROM {UNITS} WHERE type IN ('text', 'list', 'equation')",
        "unit_text_evaluation": f"SELECT * FROM (SELECT unit_id, {EVAL_TEXT} AS body FROM {UNITS} WHERE type IN {KINDS}) WHERE body <> ''",
        "title_year_quarter": title(),
        "doc_type_rules": f"""WITH b AS (SELECT doc_id AS body FROM doc_registry UNION SELECT query_text FROM queries), c AS (SELECT body, {r} AS r, {n} AS n FROM b)
            SELECT body, CASE WHEN r > n THEN 'report' WHEN n > r THEN 'notice' ELSE 'unknown' END AS doc_type, CASE WHEN r = 0 AND n = 0 THEN 0.0 WHEN r = n THEN 0.5 ELSE round(least(1.0, 0.5 + 0.1 * abs(r - n)), 6) END AS confidence FROM c""",
        "query_years": f"SELECT query_id, {period('query_text', 2024)} FROM queries",
        "relative_years": f"SELECT o_orderkey, years, quarters FROM (SELECT o_orderkey, {period('q', 2024)} FROM (SELECT o_orderkey, '{order}' AS q FROM orders))",
        "angle_parts": "SELECT query_id, query_text AS part FROM queries",
        "truncate_context": f"SELECT id, CASE WHEN length(content) > 40 THEN content[1:40] || '…' ELSE content END AS short FROM {CHUNKS}",
        "prune_none": """SELECT query_id, CASE WHEN doc_type IS NULL THEN '{"query_id":' || query_id || '}' ELSE '{"doc_type":"' || doc_type || '","query_id":' || query_id || '}' END AS json FROM queries""",
        "textify_simple_table": "SELECT n_nationkey, '国家: ' || n_name || '，列2: ' || n_nationkey || CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE '，区域: ' || r_name END || '。' AS body FROM nation JOIN region ON n_regionkey = r_regionkey",
        "textify_no_header": "SELECT r_regionkey, '列1: ' || r_name || '。' || chr(10) || '列1: ' || r_regionkey || '.' AS body FROM region",
        "chunk_pack_500": PACK,
        "chunks_rows": ROWS,
        "chunks_html": HTML,
        "tables_index": f"""SELECT doc_id || CASE WHEN p IS NOT NULL THEN '::p' || p ELSE '' END || '::t' || seq AS id, doc_id, p AS page, seq, sha1({space("coalesce(table_text, '')")}) AS digest
            FROM (SELECT *, {PAGE} AS p, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS INT) AS seq FROM {UNITS} WHERE type = 'table')""",
        "interleave_islands": f"""SELECT doc_id, island, count(*) AS units, min(unit_no) AS first, max(unit_no) AS last FROM (SELECT *, CAST(sum(CASE WHEN type = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY unit_no) AS BIGINT) AS island
            FROM {UNITS} WHERE type IN {KINDS}) WHERE type <> 'table' GROUP BY doc_id, island""",
        "chunk_level": LEVEL,
        "chunk_stats": f"SELECT source, type, count(*) AS chunk_count, round(avg(length(content)), 6) AS avg_chunk_len FROM {CHUNKS} GROUP BY ALL",
        "table_counts": f"SELECT doc_id, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'table' AND {space("coalesce(table_text, '')")} <> '') AS texts FROM {UNITS} GROUP BY doc_id",
        "bm25_postings": f"WITH {BM25} SELECT idx, rid, term, tf, dl FROM post",
        "bm25_stats": f"WITH {BM25} SELECT idx, term, df, round(idf, 6) AS idf FROM terms",
        "bm25_topk_per_index": f"""WITH {BM25}, asked AS (SELECT doc_id AS query_id, unnest({tokens('title')}) AS term FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
            qs AS (SELECT doc_id AS query_id FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
            s AS (SELECT query_id, idx, rid, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN asked USING (term) JOIN terms USING (idx, term) JOIN stats USING (idx) GROUP BY ALL),
            a AS (SELECT query_id, t.idx, t.rid, coalesce(score, 0.0) AS score FROM qs CROSS JOIN t LEFT JOIN s USING (query_id, idx, rid))
            SELECT query_id, idx, rid, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id, idx ORDER BY round(score, 9) DESC, rid) AS INT) AS rank FROM a QUALIFY rank <= 5""",
        "dense_topk_per_index": f"""SELECT q.vec_id AS query_id, e.label AS idx, e.vec_id AS rid, round({DOT.format(a="q.v", b="e.v")}, 6) AS score,
            CAST(row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY round({DOT.format(a="q.v", b="e.v")}, 9) DESC, e.vec_id) AS INT) AS rank FROM {UNIT} q, {UNIT} e WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5""",
        "l2_normalize": f"SELECT vec_id, round(v[1], 6) AS x0, round(v[64], 6) AS x63, round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS length FROM {UNIT}",
        "minmax_strict": f"SELECT query_id, modal, index_dir, rid, round(norm, 6) AS norm FROM {scaled(True)}",
        "minmax_smooth": f"SELECT query_id, modal, index_dir, rid, round(norm, 6) AS norm FROM {scaled(False)}",
        "blend_linear": f"SELECT query_id, modal, index_dir, rid, round(score_blend, 6) AS score_blend FROM {BLENDED}",
        "rrf_weighted": rrf("index_dir, rid"),
        "rrf_cross_modal": rrf("id"),
        "dedup_pretopk": f"WITH {PRUNED} SELECT query_id, modal, id, pre_rank FROM c",
        "post_filter_page": f"""WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, modal ORDER BY round(score_raw, 9) DESC, index_dir, rid) AS INT) AS rank FROM {TWO}), m AS (SELECT id, page FROM {META})
            SELECT query_id, modal, r.id, page, rank FROM r JOIN m ON m.id = r.id WHERE page IS NULL OR page BETWEEN 2 AND 3""",
        "rerank_fallback": f"WITH {FALLBACK} SELECT query_id, id, rerank_rank, rerank_score FROM s",
        "rerank_lexical": f"""WITH {PLACED}, x AS (SELECT *, list_distinct({tokens('query_text')}) AS q, list_distinct({tokens('content')}) AS t FROM e),
            y AS (SELECT *, CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) / len(q) END AS score FROM x)
            SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position) AS INT) AS rerank_rank, round(score, 6) AS rerank_score FROM y QUALIFY rerank_rank <= 10""",
        "restore_table": f"WITH {CHUNK_ROWS}, {RESTORED} SELECT hit_id, length(base) AS n, md5(base) AS hash FROM b",
        "restore_neighbours": f"""WITH {CHUNK_ROWS}, {RESTORED}, p AS (SELECT hit_id, arg_min(r.content, r.id) AS content FROM b JOIN r ON r.index_dir = b.index_dir AND r.doc_id = b.doc_id AND r.ord = b.lo - 1 GROUP BY hit_id),
            q AS (SELECT hit_id, arg_min(r.content, r.id) AS content FROM b JOIN r ON r.index_dir = b.index_dir AND r.doc_id = b.doc_id AND r.ord = b.hi + 1 GROUP BY hit_id),
            z AS (SELECT b.hit_id, coalesce(p.content || chr(10) || chr(10), '') || b.base || coalesce(chr(10) || chr(10) || q.content, '') AS x FROM b LEFT JOIN p ON p.hit_id = b.hit_id LEFT JOIN q ON q.hit_id = b.hit_id)
            SELECT hit_id, length(x) AS n, md5(x) AS hash FROM z""",
        "answer_context": f"""WITH {FALLBACK}, l AS (SELECT query_id, string_agg('[' || rerank_rank || '] doc=' || coalesce(doc_id, '') || ' page=' || coalesce(CAST(page AS VARCHAR), 'None') || ' type=' || coalesce(type, '') || chr(10)
            || CASE WHEN table_id IS NULL AND length(content) > 120 THEN content[1:120] || '…' ELSE content END, chr(10) || chr(10) ORDER BY rerank_rank) AS x FROM s GROUP BY query_id),
            y AS (SELECT query_id, CASE WHEN length(x) > 1300 THEN x[1:1200] || chr(10) || chr(10) || '[内容已截断，部分材料因长度限制未包含...]' ELSE x END AS x FROM l) SELECT query_id, length(x) AS n, md5(x) AS hash FROM y""",
        "answer_messages": f"""WITH {material(str(qs.ROOM - 100 - fixed))}, u AS (SELECT query_id, '{start}' || q || '{between}' || x || '{end}' AS u FROM y) SELECT query_id, '{qs.SYSTEM}' AS system, length(u) AS n, md5(u) AS hash FROM u""",
        "answer_sources": f"""WITH {FALLBACK}, o AS (SELECT id, ord, source_file FROM {META}) SELECT query_id, rerank_rank AS ref, s.id, coalesce(modal, 'unknown') AS modal, coalesce(doc_id, '') AS doc_id, page, CASE WHEN table_id IS NOT NULL THEN 'table_full' ELSE coalesce(type, '') END AS type, o.ord,
            md5(CASE WHEN table_id IS NULL AND length(content) > 120 THEN content[1:120] || '…' ELSE content END) AS hash, index_dir, source_file FROM s JOIN o ON o.id = s.id""",
        "answer_end_to_end": f"""WITH {material(str(qs.ROOM - 100 - len(qs.SYSTEM) - 7))}, u AS (SELECT query_id, '问：' || q || chr(10) || x || chr(10) || '再问：' AS u FROM y) SELECT query_id, '答：< “' || length(u) || ' ' || trim(u[-12:]) || '” >' AS answer FROM u""",
        "multi_query_routes": f"""WITH r AS (SELECT query_id, query_text AS t, unnest([1, 2, 3]) AS route, unnest(['mq_1', 'mq_2', 'hyde']) AS name, unnest(['换词：', '换概念：', '设想：']) AS p FROM queries),
            m AS (SELECT query_id, route, name, length(p || t) || ' ' || trim((p || t)[-12:]) AS e FROM r)
            SELECT query_id, 0 AS route, 'orig' AS name, query_text AS q FROM queries UNION ALL SELECT query_id, route, name, CASE WHEN name = 'hyde' THEN '答：< “' || e || '” >' ELSE e END FROM m""",
        "embedding_usage": f"SELECT type, CAST(coalesce(sum(greatest(1, length(body) // 2)) FILTER ({space('body')} <> ''), 0) AS BIGINT) AS tokens, count(*) FILTER ({space('body')} <> '') AS embedded FROM (SELECT type, {EVAL_TEXT} AS body FROM {UNITS}) GROUP BY type",
        "route_batch": f"WITH {batch()} SELECT * FROM routed",
        "route_decisions": f"WITH {batch()} SELECT query_id, CASE WHEN bool_or(scope = 'buckets') THEN 'year_buckets' ELSE 'global' END AS strategy, count(*) FILTER (scope = 'buckets') AS buckets, bool_or(scope <> 'buckets') AS fallback FROM routed GROUP BY query_id",
        "registry_build": f"WITH {built()} SELECT * FROM docs",
        "registry_build_index": f"""WITH {built()}, i AS (SELECT 'faiss' AS kind, doc_type, coalesce(CAST(year AS VARCHAR), 'unknown') AS year_key, 'faiss_ctrl/' || doc_id AS dir FROM a UNION ALL SELECT 'bm25', doc_type, coalesce(CAST(year AS VARCHAR), 'unknown'), 'bm25_ctrl/' || doc_id FROM later)
            SELECT kind, doc_type, year_key, count(*) AS dirs, min(dir) AS first_dir FROM i GROUP BY ALL""",
        "stored_index_search": f"""WITH fa AS (SELECT index_dir AS idx FROM {META} GROUP BY 1 HAVING max(doc_meta.doc_type) = 'report' AND max(doc_meta.year) = 2021), {BM25.replace("source AS idx, doc_id AS rid", "index_dir AS idx, rid").replace("'text'", "'embed_text'").replace("coalesce(text, '')", "coalesce(embed_text, '')").replace("FROM documents WHERE source IS NOT NULL", f"FROM {META} WHERE index_dir IN (SELECT idx FROM fa)")},
            asked AS (SELECT query_id, unnest({tokens('query_text')}) AS term FROM queries),
            s AS (SELECT query_id, idx, rid, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN asked USING (term) JOIN terms USING (idx, term) JOIN stats USING (idx) GROUP BY ALL),
            x AS (SELECT query_id, t.idx, t.rid, coalesce(score, 0.0) AS score FROM queries CROSS JOIN t LEFT JOIN s USING (query_id, idx, rid)),
            y AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, idx ORDER BY round(score, 9) DESC, rid) AS INT) AS rank FROM x QUALIFY rank <= 3),
            z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, idx, rid) AS k, count(*) OVER (PARTITION BY query_id) AS c FROM y)
            SELECT query_id, idx, rid, round(score, 6) AS score, rank FROM z WHERE k <= 20 OR k = c""",
        "lines_roundtrip": f"SELECT id, doc_id, type, page, md5(content) AS hash, ord AS \"order\", meta.year AS year, array_to_string(meta.years_mentioned, ',') AS years FROM {CHUNKS}",
        "report_append": f"SELECT source, type, count(*) AS chunk_count, round(avg(length(content)), 6) AS avg_chunk_len, CAST(run AS INT) AS run FROM {CHUNKS}, range(1, 3) t(run) GROUP BY ALL",
        "chunk_length_overlap": LENGTH,
        "chunk_semantic": SEMANTIC,
        "post_filter_type_and_page": f"""WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, modal ORDER BY round(score_raw, 9) DESC, index_dir, rid) AS INT) AS rank FROM {TWO}), m AS (SELECT id, page, type FROM {META})
            SELECT query_id, modal, r.id, page, rank FROM r JOIN m ON m.id = r.id WHERE type = 'text' AND (page IS NULL OR page >= 2)""",
        "multi_route_merge": f"""WITH r AS (SELECT query_id, id, {MODAL} AS route, CAST(row_number() OVER (PARTITION BY query_id, modal ORDER BY round(score_raw, 9) DESC, index_dir, rid) AS INT) AS rank FROM {HITS}),
            k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY route, rank) = 1) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY route, rank) AS INT) AS position FROM k""",
        "adjacent_distance": f"""WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings)
            SELECT label, count(*) AS segments, round(coalesce(avg(1 - {DOT.format(a="v", b="w")} / sqrt({DOT.format(a="v", b="v")}) / sqrt({DOT.format(a="w", b="w")})), 0), 6) AS score FROM e GROUP BY label""",
        "weighted_report": "SELECT event_type AS strategy, round(coalesce(sum(value * (user_id % 7)) / nullif(sum(user_id % 7), 0), 0), 6) AS avg_score, round(avg(event_id % 10), 6) AS avg_time, CAST(sum(user_id % 7) AS BIGINT) AS total_chunks, count(*) AS files FROM events GROUP BY 1",
        "usage_totals": "SELECT event_type, count(*) AS calls, CAST(sum(greatest(1, length(props) // 2)) AS BIGINT) AS tokens FROM events GROUP BY 1",
        "registry_docs": f"WITH {registry()} SELECT * FROM reg",
        "registry_type_year": f"SELECT doc_type, coalesce(CAST(year AS VARCHAR), 'unknown') AS year_key, count(*) AS documents, md5(string_agg(doc_id, ';' ORDER BY doc_id)) AS hash FROM {latest_docs()} WHERE doc_type IS NOT NULL GROUP BY 1, 2",
        "doc_registry_enrich": f"""WITH {registry()}, k AS (SELECT * FROM {latest_docs()}) SELECT reg.doc_id, coalesce(k.doc_type, reg.doc_type) AS doc_type, coalesce(k.year, reg.year) AS year, coalesce(k.quarter, reg.quarter) AS quarter,
            coalesce(k.source_date, reg.source_date) AS source_date FROM reg LEFT JOIN k ON k.doc_id = reg.doc_id""",
        "route_type_and_year": routed("doc_type = 'report' AND y = '2021'", sparse_of("report", [2021])),
        "route_type_unknown_year": routed("doc_type IS NOT NULL", sparse_of("notice", [2090])),
        "route_year_only": routed("doc_type IS NOT NULL AND y IN ('2020', '2021')", f"{sparse_of('report', [2020, 2021])} OR {sparse_of('notice', [2020, 2021])}"),
        "route_type_only": routed("false", sparse_of("report", [])),
        "route_nothing": routed("true", "true"),
        "route_both": routed("false", f"{sparse_of('report', [])} OR {sparse_of('notice', [])}"),
        "latest_version": f"SELECT * FROM {latest_docs()}",
        "incremental_pending": "SELECT doc_id FROM documents WHERE NOT (doc_id % 4 = 0 AND doc_id % 10 < 5)",
        "resume_reuse": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND {space('title')} <> '' THEN title ELSE 'new' END AS body FROM documents",
    }
