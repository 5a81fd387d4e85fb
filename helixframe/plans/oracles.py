"""DuckDB SQL for the queries, by definitions: extension base by base, counts over all places, sorted suffixes."""

from __future__ import annotations

from .fixtures import BASES, EXTRA_PATTERNS, LETTERS

_ENC = f"regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', 'N', 'g')"
_REF = f"ref AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS sequence_id, 'b' || item_id AS name, item_id, {_ENC} AS s FROM benchmark)"
_OFF = "off AS (SELECT sequence_id, name, '' AS description, length(s)::BIGINT AS length, (coalesce(sum(length(s) + 1) OVER (ORDER BY sequence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS global_offset, (length(s) - length(replace(s, 'N', '')))::BIGINT AS ambiguous_bases FROM ref)"
_DOC = f"doc AS (SELECT doc_id::VARCHAR AS query_id, {_ENC} AS s FROM documents)"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_EXTRA = ", ".join(f"('{p}')" for p in EXTRA_PATTERNS)
_PAT = f"pat AS (SELECT pattern AS query_id, pattern FROM (SELECT DISTINCT substr(s, i + 1, 24) AS pattern FROM (SELECT s, unnest(range(0, length(s), 24)) AS i FROM ref)) WHERE length(pattern) = 24 AND pattern NOT LIKE '%N%' UNION ALL SELECT col0, col0 FROM (VALUES {_EXTRA}))"
_TEXT = "txt AS (SELECT string_agg(translate(s, 'ACGTN', '23456'), '1' ORDER BY sequence_id) || '10' AS t FROM ref)"
_SA = "sa AS (SELECT row_number() OVER (ORDER BY substr(t, p + 1)) - 1 AS \"row\", p AS suffix FROM (SELECT t, unnest(range(0, length(t))) AS p FROM txt))"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# the text ends with a separator and the end symbol only if that is how the logical text is built
_LAST = "SELECT t AS text FROM txt"


def _strands(strands: str) -> str:
    plus = "SELECT query_id, '+' AS strand, s FROM doc"
    minus = f"SELECT query_id, '-' AS strand, {_RC.format('s')} AS s FROM doc"
    return "q AS (" + {"forward": plus, "reverse": minus, "both": f"{plus} UNION ALL {minus}"}[strands] + ")"


def _seeds(n: int, strands: str) -> list[str]:
    """qk, rk: words of query and reference; x: equal words with the length to which both sides agree."""
    cut = lambda t, keys: f"SELECT {keys}, c, substr(s, c + 1, {511 + n}) AS p FROM (SELECT {keys}, s, unnest(range(0, length(s), 512)) AS c FROM {t})"
    words = lambda t, keys: f"SELECT {keys}, c + j AS i, substr(p, j + 1, {n}) AS w FROM (SELECT {keys}, c, p, unnest(range(0, length(p) - {n - 1})) AS j FROM ({cut(t, keys)})) WHERE NOT contains(substr(p, j + 1, {n}), 'N')"
    return [
        _REF,
        _DOC,
        _strands(strands),
        f"qk AS ({words('q', 'query_id, strand')})",
        f"rk AS ({words('ref', 'sequence_id')})",
        # 500 symbols are far beyond the longest match of the tables
        """x0 AS (SELECT qk.query_id, qk.strand, rk.sequence_id, qk.i AS q, rk.i AS r, length(q.s) AS ql, substr(q.s, qk.i, 1) AS lq, substr(ref.s, rk.i, 1) AS lr,
  substr(q.s, qk.i + 1, 500) AS a, substr(ref.s, rk.i + 1, 500) AS b FROM qk JOIN rk ON qk.w = rk.w
  JOIN q ON q.query_id = qk.query_id AND q.strand = qk.strand JOIN ref ON ref.sequence_id = rk.sequence_id)""",
        f"""x AS (SELECT *, coalesce(list_position(list_transform(range({n}, least(length(a), length(b))), lambda j: a[j + 1] <> b[j + 1] OR a[j + 1] = 'N'), true) - 1 + {n}, least(length(a), length(b))) AS n FROM x0)""",
        "m AS (SELECT *, substr(a, 1, n) AS w FROM x WHERE q = 0 OR r = 0 OR lq <> lr OR lq = 'N')",
    ]


_PUBLIC = "query_id, sequence_id, r::BIGINT AS reference_position, (CASE WHEN strand = '-' THEN ql - q - n ELSE q END)::BIGINT AS query_position, n::BIGINT AS length, strand"


def _mem(n: int, strands: str) -> str:
    return _with(*_seeds(n, strands)) + f"SELECT {_PUBLIC} FROM m"


_IN_REF = "(SELECT count(*) FROM rk JOIN ref ON ref.sequence_id = rk.sequence_id WHERE rk.w = substr(m.w, 1, {n}) AND substr(ref.s, rk.i + 1, m.n) = m.w) = 1"
_IN_QUERY = "(SELECT count(*) FROM qk JOIN q ON q.query_id = qk.query_id AND q.strand = qk.strand WHERE qk.query_id = m.query_id AND qk.strand = m.strand AND qk.w = substr(m.w, 1, {n}) AND substr(q.s, qk.i + 1, m.n) = m.w) = 1"


def _unique(n: int, strands: str, in_query: bool) -> str:
    """By counting the match's string over all places."""
    where = _IN_REF.format(n=n) + (" AND " + _IN_QUERY.format(n=n) if in_query else "")
    return _with(*_seeds(n, strands)) + f"SELECT {_PUBLIC} FROM m WHERE {where}"


def _smem(n: int, strands: str, c: int) -> str:
    """The c-th longest extension from each place, without places whose interval lies in an earlier one's."""
    return _with(
        *_seeds(n, strands),
        f"e AS (SELECT query_id, strand, q, q + n AS e FROM x QUALIFY row_number() OVER (PARTITION BY query_id, strand, q ORDER BY n DESC) = {c})",
        "k AS (SELECT * FROM e QUALIFY coalesce(max(e) OVER (PARTITION BY query_id, strand ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < e, true))",
        "o AS (SELECT x.query_id, x.strand, x.sequence_id, x.r, x.q, x.ql, k.e - k.q AS n FROM x JOIN k ON x.query_id = k.query_id AND x.strand = k.strand AND x.q = k.q AND x.q + x.n >= k.e)",
    ) + f"SELECT {_PUBLIC}, count(*) OVER (PARTITION BY query_id, strand, q, n) AS reference_occurrences FROM o"


def _hits(strands: str) -> str:
    rc = _RC.format("upper(pattern)")
    p = {
        "forward": "SELECT query_id, '+' AS strand, upper(pattern) AS p FROM pat",
        "reverse": f"SELECT query_id, '-' AS strand, {rc} AS p FROM pat",
        "both": f"SELECT query_id, CASE WHEN upper(pattern) = {rc} THEN 'both' ELSE '+' END AS strand, upper(pattern) AS p FROM pat UNION ALL SELECT query_id, '-', {rc} FROM pat WHERE upper(pattern) <> {rc}",
    }[strands]
    sizes = "sizes AS (SELECT DISTINCT length(pattern) AS z FROM pat)"
    places = "places AS (SELECT sequence_id, name, i, substr(s, i + 1, z) AS w FROM (SELECT sequence_id, name, s, z, unnest(range(0, length(s) - z + 1)) AS i FROM ref, sizes))"
    return _with(_REF, _PAT, f"p AS ({p})", sizes, places, "h AS (SELECT query_id, sequence_id, name AS sequence_name, i::BIGINT AS position, length(p)::BIGINT AS length, strand FROM p JOIN places ON p = w)")


_COUNT = "SELECT pat.query_id, count(h.query_id) AS total_hits FROM pat LEFT JOIN h USING (query_id) GROUP BY pat.query_id"
_NTH = "row_number() OVER (PARTITION BY query_id ORDER BY sequence_id, position, length, strand)"
_KEY = "list_reduce(list_transform(string_split({0}, ''), lambda b: (position(b IN 'ACGT') - 1)::BIGINT), lambda a, b: a * 4 + b)"
_RANGE = "SELECT pat.query_id, coalesce(min(\"row\") FILTER (t.query_id IS NOT NULL), 0)::BIGINT AS begin, coalesce(max(\"row\") + 1, 0)::BIGINT AS \"end\" FROM pat LEFT JOIN hit t USING (query_id) GROUP BY pat.query_id"
_SAHIT = "hit AS (SELECT query_id, \"row\" FROM pat, txt, sa WHERE substr(t, suffix + 1, length(pattern)) = translate(upper(pattern), 'ACGT', '2345'))"
_REP = """rep AS (SELECT l_returnflag AS dataset, l_linestatus AS method, 'op' || (l_linenumber % 3) AS operation, l_orderkey % 5 AS repetition, l_extendedprice / 10000 AS seconds,
  l_quantity::BIGINT AS query_count, l_partkey AS query_bases, l_suppkey % 2 AS checksum, CASE WHEN l_discount > 0.085 THEN 'failed' WHEN l_tax > 0.075 THEN 'not_applicable' ELSE 'ok' END AS status FROM lineitem)"""
_SUM = "sm AS (SELECT dataset, method, operation, count(*) AS repetitions, median(seconds) AS med, min(seconds) AS lo, max(seconds) AS hi, max(query_count) AS query_count, max(query_bases) AS query_bases FROM rep GROUP BY ALL)"
# 500 symbols are far beyond the longest repeat of the tables
_LCP = """lcp AS (SELECT "row", suffix, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda j: a[j] <> b[j]), true) - 1, least(length(a), length(b))) END::BIGINT AS lcp
  FROM (SELECT "row", suffix, substr(t, suffix + 1, 500) AS a, substr(t, prev + 1, 500) AS b FROM (SELECT *, lag(suffix) OVER (ORDER BY "row") AS prev FROM sa), txt))"""
_VALID = """SELECT (SELECT count(*) FROM {sa}) = length(t) AS complete,
  (SELECT count(DISTINCT suffix) = count(*) FROM {sa}) AND (SELECT count(*) FROM range(0, length(t)) r(p) WHERE p NOT IN (SELECT suffix FROM {sa})) = 0 AS permutation,
  (SELECT count(DISTINCT "row") = count(*) AND min("row") = 0 AND max("row") = count(*) - 1 FROM {sa}) AS dense,
  length(t) - length(replace(t, '0', '')) = 1 AND right(t, 1) = '0' AS sentinel FROM txt"""
# nearest values on both sides, then the first smallest value between them, by the definitions
_CHILD = """a AS (SELECT list(lcp ORDER BY "row") AS v FROM lcp),
near AS (SELECT "row" AS i, v, lcp AS x, list_position(list_transform(list_reverse(v[1:"row"]), lambda y: y <= lcp), true) AS b, list_position(list_transform(v["row" + 2:], lambda y: y <= lcp), true) AS f FROM lcp, a),
cuts AS (SELECT i, v, x, CASE WHEN b IS NULL OR b = 0 THEN -1 ELSE i - b END AS p, CASE WHEN f IS NULL OR f = 0 THEN len(v) ELSE i + f END AS q FROM near),
parts AS (SELECT i, v, x, p, q, v[p + 2:i] AS l, v[i + 2:q] AS r FROM cuts),
child AS (SELECT i AS "row", CASE WHEN len(l) > 0 THEN p + list_position(l, list_min(l)) END AS up, CASE WHEN len(r) > 0 THEN i + list_position(r, list_min(r)) END AS down, CASE WHEN q < len(v) AND v[q + 1] = x THEN q END AS next_l FROM parts)"""
_ANCHOR = (
    "w12 AS (SELECT {key} >> 16 AS bucket, {key} AS key, \"row\" FROM (SELECT substr(s, i + 1, 12) AS w, global_offset + i AS suffix FROM (SELECT s, global_offset, unnest(range(0, length(s) - 11)) AS i FROM ref JOIN off USING (sequence_id)) WHERE NOT contains(substr(s, i + 1, 12), 'N')) JOIN sa USING (suffix))".format(key=_KEY.format("w"))
)
_ANCHORS = """have AS (SELECT bucket, min(key) AS x, arg_min("row", (key, "row")) AS y FROM w12 GROUP BY bucket),
anchors AS (SELECT b AS bucket, coalesce((SELECT x FROM have WHERE bucket <= b ORDER BY bucket DESC LIMIT 1), 0) AS x,
  coalesce((SELECT y FROM have WHERE bucket <= b ORDER BY bucket DESC LIMIT 1), (SELECT y FROM have ORDER BY bucket LIMIT 1), 0) AS y FROM range(0, 256) r(b)
  UNION ALL SELECT 256, 16777216, (SELECT count(*) FROM sa))"""


def sql() -> dict[str, str]:
    ref, off = _with(_REF), _with(_REF, _OFF)
    index = _with(_REF, _TEXT, _SA)
    out = {
        "fasta_scan": ref + "SELECT name, 'passage > of text' AS description, s AS sequence FROM ref",
        "normalize_reference": "SELECT doc_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS sequence, (length(text) - length(regexp_replace(text, '[^ACGTacgt]', '', 'g')))::BIGINT AS ambiguous_bases FROM documents",
        "logical_text": _with(_REF, _TEXT) + _LAST,
        "reference_stats": off + "SELECT count(*) AS sequence_count, sum(length)::BIGINT AS total_bases, sum(ambiguous_bases)::BIGINT AS ambiguous_bases, (sum(length) + count(*) + 1)::BIGINT AS text_symbols FROM off",
        "sequence_info": off + "SELECT * FROM off WHERE sequence_id = 3",
        "contig_offsets": off + "SELECT * FROM off",
        "map_global": off + "SELECT g::BIGINT AS global_pos, 10::BIGINT AS length, sequence_id, (g - global_offset)::BIGINT AS position FROM (SELECT unnest(range(0, (SELECT sum(length) + count(*) + 1 FROM off)::BIGINT)) AS g) JOIN off ON g >= global_offset AND g + 10 <= global_offset + length",
        "tsv_roundtrip": off + "SELECT sequence_id, name, NULL::VARCHAR AS description, length, global_offset, ambiguous_bases FROM off",
        "index_roundtrip": off + "SELECT * FROM off",
        "pattern_valid": "SELECT p_partkey, regexp_matches(translate(p_name, ' abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTACG'), '^[ACGTacgt]+$') AS valid FROM part",
        "query_runs": _with(_DOC) + "SELECT query_id, (i - 1)::BIGINT AS run_start, regexp_extract(substr(s, i), '^[ACGT]+') AS run FROM (SELECT query_id, s, unnest(range(1, length(s) + 1)) AS i FROM doc) WHERE substr(s, i, 1) <> 'N' AND (i = 1 OR substr(s, i - 1, 1) = 'N')",
        "reverse_complement": _with(_DOC) + f"SELECT query_id, {_RC.format('s')} AS sequence FROM doc",
        "is_palindrome": _with(_REF, _PAT) + f"SELECT query_id, upper(pattern) = {_RC.format('upper(pattern)')} AS palindrome FROM pat",
        "kmers": ref + "SELECT sequence_id, i::BIGINT AS pos, w AS word FROM (SELECT sequence_id, i, substr(s, i + 1, 16) AS w FROM (SELECT sequence_id, s, unnest(range(0, length(s) - 15)) AS i FROM ref)) WHERE NOT contains(w, 'N')",
        "kmer_key": ref + f"SELECT sequence_id, i::BIGINT AS pos, {_KEY.format('w')} AS key FROM (SELECT sequence_id, i, substr(s, i + 1, 31) AS w FROM (SELECT sequence_id, s, unnest(range(0, length(s) - 30)) AS i FROM ref)) WHERE NOT contains(w, 'N')",
        "strand_expand": _with(_DOC, _strands("both")) + "SELECT query_id, strand, s AS sequence FROM q",
        "ordered_checksum": _hits("both")
        + """, v AS (SELECT query_id, -1 AS sequence_id, -1 AS position, -1 AS length, '' AS strand, [count(h.query_id)] AS v FROM pat LEFT JOIN h USING (query_id) GROUP BY query_id
UNION ALL SELECT query_id, sequence_id, position, length, strand, [sequence_id, position, length, CASE strand WHEN '+' THEN 0 WHEN '-' THEN 1 ELSE 2 END] FROM h),
a AS (SELECT count(*) AS n, flatten(list(v ORDER BY query_id, sequence_id, position, length, strand)) AS v FROM v),
b AS (SELECT n, flatten(list_transform(v, lambda x: list_transform(range(0, 8), lambda k: ((x::BIGINT >> (8 * k)) & 255)::HUGEINT))) AS v FROM a)
SELECT n AS n_rows, lower(lpad(hex(list_reduce(v, lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT)::UBIGINT), 16, '0')) AS checksum FROM b""",
        "locate_top_k": _hits("both") + f"SELECT * FROM h QUALIFY {_NTH} <= 2",
        "locate_first": _hits("both") + f"SELECT query_id, sequence_id, position, length, strand FROM h QUALIFY {_NTH} = 1",
        "locate_count_only": _hits("both") + _COUNT,
        "locate_summary": _hits("both") + "SELECT pat.query_id, count(h.query_id) AS total_hits, count(h.query_id) > 1 AS truncated FROM pat LEFT JOIN h USING (query_id) GROUP BY pat.query_id",
        "right_maximal_sampled": _mem(16, "forward"),
        "mem_skip": _mem(16, "forward"),
        "search_statistics": _with(*_seeds(16, "both"), "has AS (SELECT DISTINCT w FROM rk)")
        + """SELECT doc.query_id, coalesce(l, 0) AS lookups, coalesce(e, 0) AS empty_lookups, coalesce(n, 0) AS seeds, coalesce(c, 0) AS matches FROM doc
  LEFT JOIN (SELECT query_id, count(*) AS l, count(*) FILTER (has.w IS NULL) AS e FROM qk LEFT JOIN has ON qk.w = has.w GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS n FROM x GROUP BY query_id) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS c FROM m GROUP BY query_id) USING (query_id)""",
        "mem_top_k": _mem(12, "forward") + " QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY query_position, sequence_id, reference_position, length, strand) <= 3",
        "mem_summary": _with(*_seeds(16, "forward")) + "SELECT doc.query_id, count(m.query_id) AS total_matches, count(m.query_id) > 1 AS truncated FROM doc LEFT JOIN m USING (query_id) GROUP BY doc.query_id",
        "smem_summary": f"WITH z AS ({_smem(12, 'both', 2)}) SELECT doc_id::VARCHAR AS query_id, count(z.query_id) AS total_matches, count(DISTINCT (query_position, length, strand)) FILTER (z.query_id IS NOT NULL) AS total_smems, false AS truncated FROM documents LEFT JOIN z ON z.query_id = doc_id::VARCHAR GROUP BY doc_id",
        "equal_range": _with(_REF, _TEXT, _SA, _PAT, _SAHIT) + _RANGE,
        "prefix_directory": _with(_REF, _TEXT, _SA) + f"SELECT {_KEY.format('w')} AS key, min(\"row\") AS begin, max(\"row\") + 1 AS \"end\" FROM (SELECT translate(substr(t, suffix + 1, 8), '2345', 'ACGT') AS w, \"row\" FROM sa, txt WHERE regexp_matches(substr(t, suffix + 1, 8), '^[2345]{{8}}$')) GROUP BY w".replace("{{8}}", "{8}"),
        "suffix_array": index + 'SELECT "row", suffix FROM sa',
        "suffix_at": _with(_REF, _TEXT, _SA, _PAT, _SAHIT) + 'SELECT "row", suffix FROM sa WHERE "row" IN (SELECT "row" FROM hit)',
        "sampled_sa": index + 'SELECT row_number() OVER (ORDER BY "row") - 1 AS "row", suffix FROM sa WHERE suffix % 4 = 0',
        "sampled_count": _hits("forward") + _COUNT,
        "isa": index + 'SELECT suffix AS position, "row" FROM sa',
        "lcp_array": _with(_REF, _TEXT, _SA, _LCP) + 'SELECT "row", suffix, lcp FROM lcp',
        # by comparing the kept suffixes themselves, without the values between them
        "sampled_lcp": _with(_REF, _TEXT, _SA, 'kept AS (SELECT row_number() OVER (ORDER BY "row") - 1 AS "row", suffix FROM sa WHERE suffix % 4 = 0)', _LCP.replace("FROM sa)", "FROM kept)")) + 'SELECT "row", suffix, lcp FROM lcp',
        "lcp_bytecoded": _with(_REF, _TEXT, _SA, _LCP) + 'SELECT "row", suffix, least(lcp, 255)::INTEGER AS code, CASE WHEN lcp >= 255 THEN lcp END AS overflow FROM lcp',
        "pwl_anchors": _with(_REF, _OFF, _TEXT, _SA, _ANCHOR, _ANCHORS) + "SELECT bucket, x, y FROM anchors",
        "pwl_predict": _with(_REF, _OFF, _TEXT, _SA, _ANCHOR, _ANCHORS, _PAT, f"ks AS (SELECT DISTINCT {_KEY.format('substr(upper(pattern), 1, 12)')} AS key FROM pat WHERE length(pattern) >= 12)")
        + 'SELECT key, least(CASE WHEN b.x <= a.x OR b.y <= a.y OR key <= a.x THEN a.y WHEN key >= b.x THEN b.y ELSE a.y + ((key - a.x)::HUGEINT * (b.y - a.y) + (b.x - a.x) // 2) // (b.x - a.x) END, (SELECT count(*) FROM sa) - 1)::BIGINT AS "row" FROM ks JOIN anchors a ON a.bucket = key >> 16 JOIN anchors b ON b.bucket = a.bucket + 1',
        "storage_width": ref + "SELECT n AS symbols, CASE WHEN n <= 4294967296 THEN 32 WHEN n <= 1099511627776 THEN 40 WHEN n <= 281474976710656 THEN 48 ELSE 64 END AS narrowest, CASE WHEN n <= 4294967296 THEN 32 ELSE 64 END AS width FROM (SELECT (sum(length(s)) + count(*) + 1)::BIGINT AS n FROM ref)",
        "validate_index": index + _VALID.format(sa="sa"),
        "validate_corrupt_index": _with(_REF, _TEXT, _SA, 'bad AS (SELECT "row", CASE WHEN "row" % 97 = 3 THEN suffix + 1 ELSE suffix END AS suffix FROM sa WHERE "row" <> 8)') + _VALID.format(sa="bad"),
        "child_table": _with(_REF, _TEXT, _SA, _LCP, _CHILD) + 'SELECT "row", up, down, next_l FROM child',
        "fingerprint": _with(_REF, _TEXT) + "SELECT lower(lpad(hex(h::UBIGINT), 16, '0')) AS fingerprint FROM (SELECT list_reduce(list_transform(string_split(substr(t, 1, length(t) - 2), ''), lambda c: c::HUGEINT), lambda a, c: (xor(a, c) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) AS h FROM txt)",
        "backends": "SELECT kind, name, available, supports_threads, CASE WHEN NOT available THEN 'reserved' WHEN kind = 'sa' THEN 'prefix doubling over ranked range partitions' ELSE 'occurrence counts over the Burrows-Wheeler column' END AS implementation FROM (VALUES ('sa', 'auto', true, true), ('sa', 'divsufsort', true, false), ('sa', 'caps', true, true), ('fm', 'sdsl-csa-wt-huff', true, false), ('fm', 'sdsl-csa-wt-balanced', true, false), ('fm', 'sdsl-csa-sada', false, false), ('fm', 'sdsl-csa-wt-epr', true, false)) b(kind, name, available, supports_threads)",
        "inspect": off + "SELECT unnest(['format_version', 'rows.contigs', 'rows.offsets', 'sequence_count', 'total_bases', 'ambiguous_bases', 'text_symbols']) AS key, unnest(['1.1', n::VARCHAR, n::VARCHAR, n::VARCHAR, b::VARCHAR, a::VARCHAR, (b + n + 1)::VARCHAR]) AS value FROM (SELECT count(*) AS n, sum(length)::BIGINT AS b, sum(ambiguous_bases)::BIGINT AS a FROM off)",
        "result_checksum": f"WITH r AS ({_mem(16, 'forward')}), h AS (SELECT ('0x' || substr(md5(concat_ws('|', query_id, sequence_id, reference_position, query_position, length, strand)), 1, 15))::BIGINT AS h FROM r) SELECT count(*) AS n_rows, coalesce(bit_xor(h), 0) AS xor_checksum, (coalesce(sum(h::HUGEINT), 0) % 2305843009213693951)::BIGINT AS sum_checksum FROM h",
        "bwt": index + "SELECT \"row\", (CASE WHEN suffix = 0 THEN '0' ELSE substr(t, suffix, 1) END)::INTEGER AS symbol FROM sa, txt",
        "c_table": _with(_REF, _TEXT) + "SELECT c::INTEGER AS symbol, (SELECT count(*) FROM (SELECT unnest(string_split(t, '')) AS x FROM txt) WHERE x::INTEGER < c)::BIGINT AS smaller FROM range(0, 7) r(c)",
        "fm_equal_range": _with(_REF, _TEXT, _SA, _PAT, _SAHIT) + _RANGE,
        "fm_equal_range_batch": _with(_REF, _TEXT, _SA, _PAT, _SAHIT, f"z AS ({_RANGE})") + "SELECT * FROM z UNION ALL SELECT 'x' || query_id, begin, \"end\" FROM z",
        "fm_count": _hits("forward") + _COUNT,
        "fm_count_both": _hits("both") + _COUNT,
        "fm_locate_both": _hits("both") + "SELECT * FROM h",
        "fm_locate_top_k": _hits("both") + f"SELECT * FROM h QUALIFY {_NTH} <= 2",
        "fm_count_batch": _hits("forward").rstrip() + f", z AS ({_COUNT}) SELECT * FROM z UNION ALL SELECT 'x' || query_id, total_hits FROM z",
        "fm_locate": _hits("forward") + "SELECT query_id, sequence_id, position FROM h",
        "bench_summary": _with(_REP, _SUM) + "SELECT dataset, method, operation, repetitions, round(med, 6) AS median_seconds, round(lo, 6) AS min_seconds, round(hi, 6) AS max_seconds, query_count, query_bases, round(query_count / med, 6) AS qps, round(med * 1e9 / query_count, 6) AS ns_per_query, round(query_bases / med, 6) AS bases_per_second FROM sm",
        "bench_speedup": _with(_REP, _SUM) + "SELECT a.dataset, a.method, a.operation, round(b.med / a.med, 6) AS speedup FROM sm a LEFT JOIN sm b ON b.dataset = a.dataset AND b.operation = a.operation AND b.method = 'F'",
        "nearest_rank": _with(_REP, "o AS (SELECT dataset, query_bases, row_number() OVER (PARTITION BY dataset ORDER BY query_bases) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM rep)") + "SELECT dataset, max(query_bases) FILTER (k = (50 * n + 99) // 100) AS p50, max(query_bases) FILTER (k = (95 * n + 99) // 100) AS p95, max(query_bases) FILTER (k = (99 * n + 99) // 100) AS p99 FROM o GROUP BY dataset",
        "gate_equality": _with(_REP) + "SELECT dataset, operation, repetition, count(DISTINCT checksum) AS distinct_checksum, count(DISTINCT method) AS distinct_method FROM rep GROUP BY ALL HAVING count(DISTINCT checksum) > 1 OR count(DISTINCT method) > 1",
        "hit_buckets": "WITH h AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT CASE WHEN n = 0 THEN 'user_hit_0' WHEN n = 1 THEN 'user_hit_1' WHEN n <= 10 THEN 'user_hit_2_10' WHEN n <= 1000 THEN 'user_hit_11_1000' ELSE 'user_hit_gt_1000' END AS bucket, count(*) AS n, sum(n)::BIGINT AS total_hits FROM h GROUP BY 1",
        "high_freq_skip": "SELECT user_id, count(*) AS total_hits, CASE WHEN count(*) > 12 THEN 'skipped_high_frequency' ELSE 'ok' END AS status FROM events GROUP BY user_id",
        "bench_headline": _with(_REP) + "SELECT dataset, operation, count(*) AS repetitions, round(median(seconds), 6) AS median_seconds, CASE WHEN count(DISTINCT method) = 1 THEN min(method) END AS method, CASE WHEN count(DISTINCT checksum) = 1 THEN min(checksum) END AS checksum FROM rep WHERE status = 'ok' GROUP BY dataset, operation",
        "bench_detail": _with(_REP) + "SELECT 0 AS level, dataset, NULL::VARCHAR AS method, NULL::VARCHAR AS operation, count(*) AS repetitions, round(median(seconds), 6) AS median_seconds FROM rep GROUP BY dataset UNION ALL SELECT 1, dataset, method, NULL, count(*), round(median(seconds), 6) FROM rep GROUP BY dataset, method UNION ALL SELECT 2, dataset, method, operation, count(*), round(median(seconds), 6) FROM rep GROUP BY dataset, method, operation",
        "bench_correctness": _with(_REP) + "SELECT dataset, method, operation, count(*) AS n_rows, count(*) FILTER (status = 'failed') AS unexpected, count(DISTINCT checksum) FILTER (status = 'ok') <= 1 AS deterministic FROM rep GROUP BY ALL",
        "union_by_name": "SELECT n_name AS name, n_nationkey AS nation, NULL::INTEGER AS region FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region",
        "audit_missing": _with(_REP) + "SELECT d AS dataset, m AS method, o AS operation FROM (VALUES ('A'), ('N'), ('R')) a(d), (VALUES ('F'), ('O')) b(m), (VALUES ('op0'), ('op1'), ('op2')) c(o) WHERE NOT EXISTS (SELECT 1 FROM rep WHERE status = 'ok' AND NOT (dataset = 'R' AND operation = 'op1') AND dataset = d AND method = m AND operation = o)",
        "environment": "SELECT c_nationkey::VARCHAR AS key, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS value FROM customer GROUP BY c_nationkey",
    }
    for strands in ("forward", "reverse", "both"):
        out[f"exact_count_{strands}"] = _hits(strands) + _COUNT
        out[f"exact_locate_{strands}"] = _hits(strands) + "SELECT * FROM h"
        out[f"mem_{strands}"] = _mem(16, strands)
    for strands in ("forward", "both"):
        out[f"right_maximal_{strands}"] = _mem(16, strands)
        out[f"mam_{strands}"] = _unique(12, strands, False)
        out[f"mum_{strands}"] = _unique(12, strands, True)
    for c in (1, 2, 3):
        out[f"smem_c{c}"] = _smem(12, "both", c)
    return out
