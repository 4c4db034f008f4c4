"""DuckDB SQL for the queries of this folder that SQL can express.

op4 and op7 to op11 need a hash, a trained model or a tokenizer that SQL lacks;
the tests hold them against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from vellumflow.llm.license_scan import THRESHOLD, all_templates, template_bigrams
from vellumflow.llm.quality_rules import MEASURES, POLICIES, RULES, mask

WORD = r"[^\x20\x09-\x0D]+"

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

MIX = f"""WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END::BIGINT AS size,
  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || text, '')), 1, 13))::BIGINT / pow(16, 13) AS u FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2 AS cap FROM p),
k AS (SELECT *, cap / w AS stop, row_number() OVER o AS k, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stopped,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_w, sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE AS total FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
l AS (SELECT *, (total - stopped) / open_w AS level FROM k),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT arg_min(level, k) FROM l WHERE level <= stop) * w), cap::DOUBLE) AS target FROM l),
x AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source"""


def license_sql() -> str:
    known = template_bigrams(all_templates())
    rows = ", ".join(f"({k}, '{name}', {sum(own.values())}, '{g}', {c})" for k, (name, own) in enumerate(known) for g, c in sorted(own.items()))
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    words = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS ls, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT * FROM (VALUES {rows}) AS t(template, license, size, bigram, most)),
u AS (SELECT rid, 0 AS line, {words.format("text")} AS ws FROM d WHERE len(ls) > 1 UNION ALL SELECT rid, line, {words.format("l")} FROM (SELECT rid, unnest(range(1, len(ls) + 1))::INT AS line, unnest(ls) AS l FROM d)),
b AS (SELECT rid, line, len(ws) - 1 AS n, unnest(list_zip(ws[:-2], ws[2:])) AS g FROM u WHERE len(ws) > 1),
c AS (SELECT rid, line, n, template, license, size, least(count(*), any_value(most)) AS common FROM b JOIN t ON bigram = g[1] || ' ' || g[2] WHERE n >= size * {low!r}::DOUBLE AND n <= size * {high!r}::DOUBLE GROUP BY rid, line, n, template, license, size, bigram),
s AS (SELECT rid, line, license, 2.0::DOUBLE * sum(common) / (n + size) AS dice FROM c GROUP BY rid, line, n, template, license, size),
k AS (SELECT rid, CASE WHEN line > 0 THEN 'line' ELSE 'text' END AS unit, line AS place, license, dice FROM s WHERE dice >= {THRESHOLD}::DOUBLE QUALIFY row_number() OVER (PARTITION BY rid, line ORDER BY dice DESC, license) = 1),
w AS (SELECT rid, {words.format("text")} AS ws FROM d),
p AS (SELECT rid, unnest(range(0, len(ws) - 1))::INT AS pos, unnest(list_zip(ws[:-2], ws[2:])) AS g FROM w WHERE len(ws) > 1),
m AS (SELECT rid, pos, template, license, size, bigram, most, count(*) OVER (PARTITION BY rid, template ORDER BY pos RANGE BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS inside FROM p JOIN t ON bigram = g[1] || ' ' || g[2]),
h AS (SELECT rid, template, license, size, pos AS start FROM m WHERE inside >= size * {THRESHOLD}::DOUBLE),
e AS (SELECT h.rid, h.template, h.license, h.size, start, least(count(*), any_value(most)) AS common FROM h JOIN m ON m.rid = h.rid AND m.template = h.template AND pos >= start AND pos < start + h.size GROUP BY h.rid, h.template, h.license, h.size, start, bigram),
f AS (SELECT rid, template, license, size, start, sum(common)::BIGINT AS common FROM e GROUP BY rid, template, license, size, start),
q AS (SELECT *, row_number() OVER (PARTITION BY rid, template ORDER BY common DESC, start) AS k FROM f WHERE common::DOUBLE / size >= {THRESHOLD}::DOUBLE),
x AS (SELECT rid, template, 0::BIGINT AS k, []::INT[] AS taken FROM q WHERE k = 1 UNION ALL SELECT q.rid, q.template, q.k, CASE WHEN len(list_filter(x.taken, lambda o: abs(o - q.start) < q.size)) = 0 THEN list_append(x.taken, q.start) ELSE x.taken END FROM x JOIN q ON q.rid = x.rid AND q.template = x.template AND q.k = x.k + 1),
y AS (SELECT rid, template, unnest(arg_max(taken, k)) AS start FROM x GROUP BY rid, template),
z AS (SELECT rid, 'window' AS unit, start + 1 AS place, license, max(common::DOUBLE / size) AS dice FROM y JOIN q USING (rid, template, start) GROUP BY rid, start, license)
SELECT doc_id, unit, place, license, dice FROM (SELECT * FROM k UNION ALL SELECT * FROM z) JOIN d USING (rid)"""


LEDGER = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(ws[1:len(ws) - 2]) AS a, unnest(ws[2:len(ws) - 1]) AS b, unnest(ws[3:]) AS z FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, z) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
ledger AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_distinct(ws))::BIGINT AS n_distinct,
  length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims, length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits
  FROM w LEFT JOIN rep USING (doc_id)),
bits AS (SELECT *, ({" | ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))})::BIGINT AS fail_bits FROM ledger)"""


def ablation_sql(policy: str) -> str:
    m = mask(policy)
    names = [n for n, _ in RULES]
    each = [f"SELECT '{r}' AS rule, count(*) FILTER ((fail_bits & {1 << names.index(r)}) <> 0) AS n_failed, count(*) FILTER ((fail_bits & {m}) = {1 << names.index(r)}) AS n_failed_alone, count(*) FILTER ((fail_bits & {m & ~(1 << names.index(r))}) = 0) AS n_kept_without FROM bits" for r in POLICIES[policy]]
    return f"{LEDGER} {' UNION ALL '.join(each)}"


def policies_sql() -> str:
    each = [f"SELECT '{p}' AS policy, count(*) FILTER ((fail_bits & {mask(p)}) = 0) AS n_kept, count(*) FILTER ((fail_bits & {mask(p)}) <> 0) AS n_failed FROM bits" for p in POLICIES]
    return f"{LEDGER} {' UNION ALL '.join(each)}"


LM = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
e AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM t),
p AS (SELECT *, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT *, count(*) OVER () - count(*) OVER (PARTITION BY rid) AS n, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY rid, w) AS c1,
  count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY rid, v, w) AS c2, count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY rid, u, v, w) AS c3 FROM p),
x AS (SELECT *, lag(c1) OVER o AS x1, lag(c2) OVER o AS x2, least(i, 3) AS k FROM c WINDOW o AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT rid, CASE WHEN k = 3 AND c3 > 0 THEN log10(c3) - log10(x2) WHEN k >= 2 AND c2 > 0 THEN log10(c2) - log10(x1) + (k - 2) * log10(0.4)
  WHEN c1 > 0 THEN log10(c1) - log10(greatest(n, 1)) + (k - 1) * log10(0.4) ELSE k * log10(0.4) - log10(greatest(n, 1)) END AS s FROM x),
a AS (SELECT rid, count(*) AS n, sum(s) AS s FROM s GROUP BY rid)
SELECT doc_id, coalesce(a.n, 0)::BIGINT AS n_words, round(coalesce(a.s, 0), 6) AS log_score FROM t LEFT JOIN a USING (rid)"""


JOIN = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM d),
e AS (SELECT rid, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.rid AS a, b.rid AS b FROM e a JOIN e b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (SELECT rid AS a, rid AS b FROM s UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(t.doc_id) AS component_id FROM c JOIN s ON c.a = s.rid JOIN s t ON c.b = t.rid GROUP BY s.rid, s.doc_id, len(s.g)"""

AUDIT = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
f AS (SELECT part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails,
  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic FROM d),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order FROM l v JOIN l w ON w.c <> v.c JOIN l x ON x.c NOT IN (v.c, w.c) JOIN l y ON y.c NOT IN (v.c, w.c, x.c) JOIN l z ON z.c NOT IN (v.c, w.c, x.c, y.c)),
t AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, list_transform(string_split(filter_order, ''), lambda c: ascii(c) - 64)[1:step] AS upto FROM o, range(1, 6) r(step)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
m AS (SELECT part, filter_order, step, own, n, good, toxic, fails[ascii(own) - 64] AS here, len(list_filter(upto[1:step - 1], lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS k FROM g, t),
a AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (here AND k = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost FROM m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a"""


def oracle_sql() -> dict[str, str]:
    assert MEASURES[:1] == ["n_words"]
    return {
        "op1_exact_top_k": TOP_K,
        "op2_mix_sources": MIX,
        "op3_license_scan": license_sql(),
        "op5_quality_rules": f"{LEDGER} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (fail_bits & {mask('v1')}) = 0 AS kept, fail_bits FROM bits",
        "rule_ablation": ablation_sql("v1"),
        "rule_policies": policies_sql(),
        "op6_lm_scoring": LM,
        "op12_ngram_join": JOIN,
        "op13_filter_audit": AUDIT,
    }
