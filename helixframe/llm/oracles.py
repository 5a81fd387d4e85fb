"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import SYMBOLS

_OP2 = """
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
rates AS (SELECT source, (1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM sizes)) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes),
parts AS (SELECT source, greatest(1, ceil(rate / 32))::BIGINT AS parts, rate / greatest(1, ceil(rate / 32)) AS r FROM rates),
steps AS (SELECT source, r, unnest(range(0, (ceil(r + 12 * sqrt(r) + 24))::BIGINT + 1)) AS k FROM parts),
terms AS (SELECT source, k, exp(sum(CASE WHEN k = 0 THEN -r ELSE ln(r / k) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM steps),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
draws AS (SELECT d.*, p.parts, unnest(range(1, p.parts + 1)) AS i FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
counted AS (SELECT doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars,
  sum(len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('17|' || doc_id || '|' || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)))::BIGINT AS n
  FROM draws JOIN cdf USING (source) GROUP BY doc_id),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy, md5('17|order|' || doc_id || '|' || copy) AS shuffle_key FROM copies
"""

_OP4 = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, turn - min(turn) OVER (PARTITION BY conv_id) AS place FROM t),
c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(place || chr(1) || role || chr(2) || text || chr(3), '' ORDER BY place, role, text) AS s FROM p GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, s, count(*)::BIGINT AS n_copies FROM c GROUP BY n_turns, s),
k AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.n_turns > a.n_turns AND substr(b.s, 1, length(a.s)) = a.s)),
r AS (SELECT p.*, k.n_turns, k.n_copies, (row_number() OVER (PARTITION BY conv_id ORDER BY place, role, text) - 1) AS at FROM p JOIN k USING (conv_id))
SELECT conv_id, (at // 256)::BIGINT AS chunk, n_turns, count(*)::BIGINT AS chunk_turns, n_copies,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY at) AS text
FROM r GROUP BY conv_id, at // 256, n_turns, n_copies
"""

_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT w.doc_id, count(s.sh)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
f AS (SELECT sh, count(*) AS df FROM s GROUP BY sh),
r AS (SELECT s.doc_id, s.sh, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.df, s.sh) AS k FROM s JOIN f USING (sh) JOIN n USING (doc_id)),
x AS (SELECT * FROM r WHERE k <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM cand JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b AND q.sh = p.sh JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  GROUP BY a, b, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a)
SELECT doc_id, n.n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n.n
"""

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_OP8 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
  OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 5 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words
  OR length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^a-z]', '', 'g'))
  OR 10 * len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{{L}}'))) > 3 * n_words) AS kept
FROM b
"""

ORACLES: dict[str, str] = {"op2_source_mix": _OP2, "op4_chat_collapse": _OP4, "op5_threshold_topk": _OP5, "op6_near_duplicates": _OP6, "op8_quality_rules": _OP8}
