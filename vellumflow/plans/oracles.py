"""The same queries in DuckDB's SQL.

Edit distances are compared on lines whose signs beyond ASCII are one sign, since
DuckDB counts bytes; the queries over all signs have none, the tests compute those by hand.
"""

from __future__ import annotations

import unicodedata

from vellumflow.functions.text import ABBREVIATIONS, AFTER_J, AFTER_U, by_length
from vellumflow.operators.stats import SIGNS
from vellumflow.operators.topics import STOPWORDS

WS = r"[\s\x1c-\x1f\x0b\x{85}\p{Z}]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chain(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    return expr


#: Decomposition of the Latin letters below U+0250.
NFD = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c)) != chr(c)]


def ws(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {q(WS)}, ' ', 'g'), ' ')"


def nfd(expr: str) -> str:
    return ws(chain(expr, NFD))


def uv(expr: str) -> str:
    return f"regexp_replace({expr}, '(^|[^\\p{{L}}\\p{{N}}_])u([{AFTER_U}])', '\\1v\\2', 'gi')"


def ij(expr: str) -> str:
    return f"regexp_replace({expr}, '(^|[^\\p{{L}}\\p{{N}}_])j([{AFTER_J}])', '\\1i\\2', 'gi')"


def abbr(expr: str) -> str:
    return chain(expr, by_length(ABBREVIATIONS))


def punct(expr: str) -> str:
    return ws(f"translate({expr}, '·¶', ' .')")


def norm(expr: str) -> str:
    return punct(ij(uv(nfd(abbr(expr)))))


LINES = f"""lines AS (SELECT * FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10)))))::INT AS line_no FROM documents) WHERE {ws('line')} <> '')"""
CONF = "(n_chars % 100) / 100.0::DOUBLE"


def of_lines(out: str) -> str:
    return f"WITH {LINES} SELECT doc_id, line_no, {out} AS out FROM lines"


SPLIT = """grps AS (SELECT DISTINCT source AS grp FROM documents WHERE source IS NOT NULL),
t1 AS (SELECT s1, grp, row_number() OVER (PARTITION BY s1 ORDER BY md5(s1::VARCHAR || ':' || grp), grp) AS k, count(*) OVER (PARTITION BY s1) AS n FROM grps, seeds1),
t2 AS (SELECT s1, grp, k <= ceil(0.15::DOUBLE * n) AS is_test FROM t1),
r1 AS (SELECT s1, s2, grp, row_number() OVER (PARTITION BY s1, s2 ORDER BY md5(s2::VARCHAR || ':val:' || grp), grp) AS k, count(*) OVER (PARTITION BY s1, s2) AS n FROM t2 JOIN pairs USING (s1) WHERE NOT is_test),
assigned AS (SELECT s1, s2, grp, CASE WHEN k <= ceil((0.15::DOUBLE / (1 - 0.15::DOUBLE)) * n) THEN 'val' ELSE 'train' END AS split FROM r1
  UNION ALL SELECT s1, s2, grp, 'test' FROM t2 JOIN pairs USING (s1) WHERE is_test)"""
ONE = "seeds1 AS (SELECT 42 AS s1), pairs AS (SELECT 42 AS s1, 42 AS s2), "
TOKENS = """facts AS (SELECT doc_id, w AS word, CASE WHEN w IN ('The','Les') THEN 'LOC' WHEN w IN ('Der','Ein') THEN 'ORG' ELSE 'MISC' END AS entity, 0.95::DOUBLE AS score
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents) WHERE w IN ('The','Les','Der','Ein','Los','Una'))"""


SHARED = """n AS (SELECT g, count(*) AS n FROM k GROUP BY g), s AS (SELECT x.g AS a, y.g AS b, count(*) AS n_shared FROM k x JOIN k y ON x.k = y.k AND x.g < y.g GROUP BY x.g, y.g)
SELECT a, b, n1.n AS n_a, n2.n AS n_b, n_shared FROM s JOIN n n1 ON n1.g = a JOIN n n2 ON n2.g = b"""


def poisson_steps() -> list[float]:
    import math

    out, total, p = [], 0.0, math.exp(-1)
    for k in range(8):
        total += p
        out.append(total)
        p /= k + 1
    return out


def folded(expr: str) -> str:
    return f"regexp_replace({expr}, '[^\\x00-\\x7F]', '?', 'g')"


def cer(pred: str, gold: str) -> str:
    return f"CASE WHEN length({gold}) = 0 THEN 0 ELSE levenshtein({pred}, {gold}) / length({gold})::DOUBLE END"


def escaped(expr: str) -> str:
    return chain(expr, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def oracle_sql() -> dict[str, str]:
    langs = ["en", "fr", "de", "es"]
    per_lang = ", ".join(f"count(*) FILTER (lang = '{x}') AS c{i}" for i, x in enumerate(langs))
    sums = ", ".join(f"sum(c{i})::DOUBLE AS c{i}" for i in range(4))
    alls = ", ".join(f"sum(c{i})::DOUBLE AS a{i}" for i in range(4))
    far = " + ".join(f"pow(c{i} / n - a{i} / a, 2)" for i in range(4))
    draws = " + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in poisson_steps())
    lanes = " || ':' || ".join(f"sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT::HUGEINT)::VARCHAR" for i in range(4))
    signs = "|".join(SIGNS)
    first = "regexp_extract(text, '^[^ \\n]+')"
    two = "'^([^ \\n]+)[ \\n]([^ \\n]+)'"
    return {
        "norm_changed_by_lang": f"WITH {LINES} SELECT lang, count(*) AS n_lines, count(*) FILTER (line <> {norm('line')}) AS n_changed, round(count(*) FILTER (line <> {norm('line')}) / count(*), 6) AS share FROM lines GROUP BY lang",
        "normalized_lines": of_lines(norm("line")),
        "nfd_lines": of_lines(nfd("line")),
        "abbr_expand": of_lines(abbr("line")),
        "ws_collapse": of_lines(ws("line")),
        "uv_initial": of_lines(uv("line")),
        "ij_initial": of_lines(ij("line")),
        "punct_norm": of_lines(punct("line")),
        "char_prefix": of_lines("left(line, 32)"),
        "cer_ascii_pairs": f"WITH {LINES}, g AS (SELECT doc_id, line_no, {folded('line')} AS g FROM lines) SELECT doc_id, line_no, round({cer("replace(g, 'th', 't')", 'g')}, 6) AS cer FROM g",
        "normalization_impact_ascii": f"WITH {LINES}, g AS (SELECT lang, {folded('line')} AS g, {folded(norm('line'))} AS n FROM lines) SELECT lang, count(*) AS n, count(*) FILTER (g <> n) AS n_changed, round(avg({cer('n', 'g')}), 6) AS mean_cer FROM g GROUP BY lang",
        "recognition_summary": f"WITH {LINES}, g AS (SELECT lang, {folded('line')} AS g FROM lines), e AS (SELECT CASE WHEN lang <> 'de' THEN {cer("replace(g, 'th', 't')", 'g')} END AS e FROM g) SELECT count(e) AS n, count(*) - count(e) AS n_errors, round(avg(e), 6) AS mean_cer, round(1 - coalesce(avg(e), 1), 6) AS accuracy FROM e",
        "first_row": "SELECT lang, doc_id, source FROM documents ORDER BY lang NULLS FIRST, doc_id NULLS FIRST LIMIT 1",
        "tail_rows": "SELECT lang, doc_id, source FROM documents ORDER BY lang DESC NULLS LAST, doc_id DESC NULLS LAST LIMIT 5",
        "allowed_sources": "SELECT doc_id, source FROM documents WHERE source LIKE '%1' OR source LIKE '%2'",
        "filter_lang_set": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('fr', 'es')",
        "has_labels": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "missing_labels": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "value_counts_source": "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source",
        "value_share_lang": "SELECT lang, round(count(*) / (SELECT count(lang) FROM documents), 3) AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang",
        "nunique_groups": "SELECT count(DISTINCT source) AS n_groups, count(DISTINCT lang) AS n_langs, count(*) AS n FROM documents",
        "union_aligned": "SELECT text, NULL::VARCHAR AS image_path, lang AS language, NULL::VARCHAR AS century, source AS shelfmark, NULL::VARCHAR AS project, 'documents' AS source_corpus FROM documents UNION ALL SELECT text, NULL, NULL, NULL, conv_id::VARCHAR, NULL, 'conversations' FROM conversations UNION ALL SELECT text, NULL, NULL, NULL, item_id::VARCHAR, NULL, 'benchmark' FROM benchmark",
        "sample_md5": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 200",
        "group_split": f'WITH {ONE}{SPLIT} SELECT grp AS "group", split FROM assigned',
        "split_search": f"""WITH seeds1 AS (SELECT range::INT AS s1 FROM range(60)), pairs AS (SELECT s1, r.range::INT AS s2 FROM seeds1, range(60) r), {SPLIT},
counts AS (SELECT source AS grp, count(*) AS n, {per_lang} FROM documents WHERE source IS NOT NULL GROUP BY source),
whole AS (SELECT sum(n)::DOUBLE AS a, {alls} FROM counts),
parts AS (SELECT x.s1 AS x1, x.s2 AS x2, split, sum(n)::DOUBLE AS n, {sums} FROM assigned x JOIN counts USING (grp) GROUP BY ALL),
scored AS (SELECT x1, x2, round(sum(pow(n / a - CASE split WHEN 'train' THEN 1 - 0.15::DOUBLE - 0.15::DOUBLE ELSE 0.15::DOUBLE END, 2) + {far}), 12) AS score FROM parts, whole GROUP BY x1, x2)
SELECT score, x1 AS seed1, x2 AS seed2 FROM scored ORDER BY score, x1, x2 LIMIT 1""",
        "split_search_by_size": f"""WITH seeds1 AS (SELECT range::INT AS s1 FROM range(60)), pairs AS (SELECT s1, r.range::INT AS s2 FROM seeds1, range(60) r), {SPLIT},
counts AS (SELECT source AS grp, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
whole AS (SELECT sum(n)::DOUBLE AS a FROM counts),
parts AS (SELECT x.s1 AS x1, x.s2 AS x2, split, sum(n)::DOUBLE AS n FROM assigned x JOIN counts USING (grp) GROUP BY ALL),
scored AS (SELECT x1, x2, round(sum(pow(n / a - CASE split WHEN 'train' THEN 1 - 0.15::DOUBLE - 0.15::DOUBLE ELSE 0.15::DOUBLE END, 2)), 12) AS score FROM parts, whole GROUP BY x1, x2)
SELECT score, x1 AS seed1, x2 AS seed2 FROM scored ORDER BY score, x1, x2 LIMIT 1""",
        "split_rows": f"WITH {ONE}{SPLIT} SELECT split, count(*) AS n, count(DISTINCT source) AS n_groups FROM documents JOIN assigned ON source = grp GROUP BY split",
        "split_leak_check": f"WITH {ONE}{SPLIT} SELECT source, count(DISTINCT split) AS n_splits FROM documents JOIN assigned ON source = grp GROUP BY source HAVING count(DISTINCT split) > 1",
        "content_sha256": f"SELECT source, count(*) AS n, sha256(count(*)::VARCHAR || ':' || {lanes}) AS sha256 FROM (SELECT source, sha256(text) AS d FROM documents) GROUP BY source",
        "dense_index": "SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS index FROM documents",
        "kept_index": "SELECT doc_id, source_idx, 'images/ligne_' || source_idx || '.png' AS image_path FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id, lang) - 1 AS source_idx FROM documents) WHERE lang = 'fr'",
        "arrow_split": "SELECT doc_id, md5(text) AS md5 FROM documents WHERE source LIKE '%1'",
        "journal_entries": "SELECT conv_id AS id, turn AS step, CASE WHEN turn = 0 THEN text END AS said, (CASE WHEN turn <> 0 THEN length(text) ELSE 0 END)::INT AS signs FROM conversations",
        "text_overlaps": f"WITH k AS (SELECT DISTINCT source AS g, text AS k FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), {SHARED}",
        "word_overlaps": f"WITH {LINES}, k AS (SELECT DISTINCT lang AS g, regexp_extract(line, '^[^ ]*') AS k FROM lines WHERE lang IS NOT NULL), {SHARED}",
        "entity_counts": f"WITH {TOKENS} SELECT entity, count(*) AS n, round(avg(score), 3) AS mean_score, round(avg((score > 0.8)::INT), 4) AS share_high FROM facts GROUP BY entity",
        "entity_density": f"WITH {TOKENS} SELECT (SELECT count(*) FROM facts) AS n_entities, count(*) AS n_lines, round((SELECT count(*) FROM facts) / greatest(count(*), 1), 6) AS per_line FROM documents",
        "entity_prf": f"""WITH {TOKENS}, p AS (SELECT DISTINCT doc_id, lower(word) AS w, entity AS g FROM facts), t AS (SELECT DISTINCT doc_id, 'the' AS w, 'LOC' AS g FROM labels),
n AS (SELECT (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM t) AS n_gold, (SELECT count(*) FROM p JOIN t USING (doc_id, w, g)) AS n_correct),
r AS (SELECT *, CASE WHEN n_pred > 0 THEN n_correct / n_pred ELSE 0 END AS p, CASE WHEN n_gold > 0 THEN n_correct / n_gold ELSE 0 END AS c FROM n)
SELECT round(p, 4) AS precision, round(c, 4) AS recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 4) AS f1, n_pred, n_gold, n_correct FROM r""",
        "cooccurrence_edges": f"WITH {TOKENS}, d AS (SELECT DISTINCT doc_id, word FROM facts) SELECT x.word AS a, y.word AS b, count(*) AS n FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.word < y.word GROUP BY x.word, y.word",
        "analyze_benchmark": f"SELECT item_id, text AS original, {norm('text')} AS normalized, len(list_filter(regexp_extract_all({norm('text')}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('The','Les','Der','Ein','Los','Una')))::INT AS n_entities, NULL::VARCHAR AS problem FROM benchmark",
        "analyze_documents": f"SELECT doc_id, text AS original, {norm('text')} AS normalized, len(list_filter(regexp_extract_all({norm('text')}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('The','Les','Der','Ein','Los','Una')))::INT AS n_entities, NULL::VARCHAR AS problem FROM documents",
        "tei_docs": f"""SELECT doc_id, '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>' || {escaped('source')} || '</title></titleStmt><sourceDesc><msDesc><msIdentifier>' || {escaped('source')} || '</msIdentifier></msDesc></sourceDesc></fileDesc></teiHeader><text><body><div><p><persName type="PER">' || {escaped(first)} || '</persName>' || {escaped(f'substr(text, length({first}) + 1)')} || '</p></div></body></text></TEI>' AS tei FROM documents""",
        "tei_two_entities": f"""WITH w AS (SELECT *, regexp_extract(text, {two}, 1) AS a, regexp_extract(text, {two}, 2) AS b FROM documents) SELECT doc_id, '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>' || {escaped('source')} || '</title></titleStmt><sourceDesc><msDesc><msIdentifier>' || {escaped('source')} || '</msIdentifier></msDesc></sourceDesc></fileDesc></teiHeader><text><body><div><p>' || CASE WHEN b <> '' THEN '<persName type="PER">' || {escaped('a')} || '</persName>' || {escaped('substr(text, length(a) + 1, 1)')} || '<placeName type="LOC">' || {escaped('b')} || '</placeName>' || {escaped('substr(text, length(a) + length(b) + 2)')} ELSE {escaped('text')} END || '</p></div></body></text></TEI>' AS tei FROM w""",
        "eda_stats": f"SELECT count(text) AS n_lines, round(avg(length(text)), 6) AS mean_length, quantile_cont(length(text), 0.5) AS median_length, count(*) FILTER (len(regexp_extract_all(text, '{signs}')) > 0) AS n_with_signs, sum(len(regexp_extract_all(text, '{signs}')))::BIGINT AS n_signs, round(avg({CONF}), 6) AS mean_confidence, round(avg(({CONF} < 0.7 OR length(text) < 5)::INT), 6) AS review_share FROM documents",
        "needs_review_rate": f"SELECT lang, round(avg(({CONF} < 0.7 OR length(text) < 5)::INT), 6) AS readme, round(avg(({CONF} < 0.6 OR length(text) < 3)::INT), 6) AS article FROM documents GROUP BY lang",
        "top_abbrev_chars": f"SELECT sign, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{signs}')) AS sign FROM documents) GROUP BY sign ORDER BY n DESC, sign LIMIT 5",
        "alphabet_size": "SELECT count(*) AS n_signs, sum(n)::BIGINT AS n_chars FROM (SELECT sign, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS sign FROM documents) GROUP BY sign)",
        "mcnemar_labels": "WITH n AS (SELECT count(*) FILTER (quality = 1 AND toxic <> 0) AS n_a_only, count(*) FILTER (quality <> 1 AND toxic = 0) AS n_b_only FROM labels) SELECT n_a_only, n_b_only, round(CASE WHEN n_a_only + n_b_only > 0 THEN pow(abs(n_a_only - n_b_only), 2) / (n_a_only + n_b_only) ELSE 0 END, 6) AS chi2 FROM n",
        "bootstrap_ci": f"""WITH c AS (SELECT quality::DOUBLE AS v, count(*) AS c FROM labels WHERE quality IS NOT NULL GROUP BY quality), i AS (SELECT v, c, unnest(CASE WHEN c > 64 THEN [0] ELSE range(1, c + 1) END) AS i FROM c),
d AS (SELECT r.range AS r, v, c, i, md5('42:' || r.range || ':' || v || ':' || i) AS d FROM i, range(1000) r), u AS (SELECT *, ('0x' || substr(d, 1, 13))::BIGINT / pow(16, 13) AS u, ('0x' || substr(d, 14, 13))::BIGINT / pow(16, 13) AS x FROM d),
w AS (SELECT r, v, CASE WHEN i = 0 THEN greatest(0, floor(c + sqrt(c) * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * x) + 0.5::DOUBLE)) ELSE {draws} END AS w FROM u), m AS (SELECT r, sum(v * w) / sum(w) AS m FROM w GROUP BY r)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(m) AS n_rounds FROM m""",
        "bbox_iou": "WITH b AS (SELECT l_linenumber AS n, l_quantity::INT AS q FROM lineitem), i AS (SELECT n, q, greatest(0, q - n) * 8 AS w FROM b), u AS (SELECT w / (q * 10 + q * 8 - w)::DOUBLE AS iou FROM i) SELECT count(iou) AS n, round(avg(iou), 6) AS mean_iou, round(quantile_cont(iou, 0.5), 6) AS median_iou, count(*) FILTER (iou > 0.75) AS n_over_75, count(*) FILTER (iou > 0.85) AS n_over_85 FROM u",
        "line_matching": """WITH RECURSIVE b AS (SELECT l_orderkey AS page, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS id, l_partkey % 40 * 10 AS x, l_linenumber * 12 AS y, l_suppkey % 13 AS m, l_quantity::INT AS q FROM lineitem),
o AS (SELECT t.page, t.id AS truth, p.id AS pred, greatest(0, least(t.x + 100 + 4 * t.q, p.x + 100 + 3 * p.q) - greatest(t.x, p.x + p.m - 3)) * greatest(0, least(t.y + 18, p.y + p.m + 12) - greatest(t.y, p.y + p.m - 6)) AS shared, (100 + 4 * t.q) * 18 + (103 + 3 * p.q - p.m) * 18 AS sizes FROM b t JOIN b p USING (page)),
k AS (SELECT page, truth, pred, shared / (sizes - shared)::DOUBLE AS iou FROM o WHERE shared > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY iou DESC, md5(truth || ':' || pred), truth, pred) AS nth FROM k),
w AS (SELECT page, 0::BIGINT AS nth, []::VARCHAR[] AS ts, []::VARCHAR[] AS ps, []::DOUBLE[] AS ious FROM r WHERE nth = 1
  UNION ALL SELECT page, nxt, CASE WHEN free THEN list_append(ts, truth) ELSE ts END, CASE WHEN free THEN list_append(ps, pred) ELSE ps END, CASE WHEN free THEN list_append(ious, iou) ELSE ious END
  FROM (SELECT w.*, r.nth AS nxt, r.truth, r.pred, r.iou, NOT list_contains(w.ts, r.truth) AND NOT list_contains(w.ps, r.pred) AS free FROM w JOIN r ON r.page = w.page AND r.nth = w.nth + 1) AS r),
f AS (SELECT page, unnest(arg_max(ious, nth)) AS iou FROM w GROUP BY page),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT page, id FROM b))
SELECT count(*) AS n_matched, any_value(n.n) - count(*) AS n_missed, any_value(n.n) - count(*) AS n_invented, round(avg(iou), 6) AS mean_iou, round(quantile_cont(iou, 0.5), 6) AS median_iou, count(*) FILTER (iou > 0.75) AS n_over_75, count(*) FILTER (iou > 0.85) AS n_over_85 FROM f, n""",
        "event_sessions": """WITH e AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER u > INTERVAL 30 MINUTE, true)::INT AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS first_at, max(ts) + INTERVAL 30 MINUTE AS ends_at, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
        "clipped_boxes": """WITH p AS (SELECT l_linenumber, l_quantity::INT AS q, l_linenumber AS n FROM lineitem), b AS (SELECT l_linenumber, greatest(0, least(q, n - 2, -3)) AS x0, greatest(0, least(n, q - 20, n + 2)) AS y0, greatest(0, least(40, greatest(q, n - 2, -3))) AS x1, greatest(0, least(6, greatest(n, q - 20, n + 2))) AS y1 FROM p)
SELECT l_linenumber, count(*) AS n, sum(x0) AS x0, sum(y0) AS y0, sum(x1) AS x1, sum(y1) AS y1 FROM b GROUP BY l_linenumber""",
        "shelf_docs": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS document, count(*) AS n_lines FROM conversations GROUP BY conv_id",
        "ctfidf_terms": f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS tf FROM w WHERE term NOT IN ({', '.join(map(q, STOPWORDS))}) GROUP BY lang, term),
k AS (SELECT lang, sum(tf) AS cw FROM c GROUP BY lang), f AS (SELECT term, sum(tf) AS tc FROM c GROUP BY term), s AS (SELECT lang, term, tf, round(tf / cw * ln(1 + (SELECT avg(cw) FROM k) / tc), 6) AS weight FROM c JOIN k USING (lang) JOIN f USING (term))
SELECT lang, term, tf, weight FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) <= 20""",
        "dup_overlap": "WITH a AS (SELECT text IN (SELECT text FROM documents WHERE source <> 'src0') AS hit FROM documents WHERE source = 'src0') SELECT count(*) AS n, count(*) FILTER (hit) AS n_shared, round(count(*) FILTER (hit) / count(*), 6) AS share FROM a",
        "contract_lines": f"SELECT doc_id::VARCHAR AS id, source AS shelfmark, {norm('text')} AS text_normalized, {CONF} AS confidence, ({CONF} < 0.7 OR length(text) < 5) AS needs_review FROM documents",
        "page_basenames": "SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS name FROM pages",
    }
