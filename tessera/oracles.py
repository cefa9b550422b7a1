"""SQL of the log engine's queries for DuckDB, written from the semantics, not from the Spark plans."""

from __future__ import annotations

EVENTS = """L AS (
  SELECT CAST(event_id // 4000 AS INTEGER) AS chunk_id, event_id AS row_no,
    strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' - ' || upper(event_type) || ' [worker-' || (user_id % 3) || ':' || event_type || '@' ||
    CAST(floor(value) AS BIGINT) || '] - id ' || event_id || ' /api/v1/' || event_type || '/' || user_id || ' ' || props AS line
  FROM events)"""

ORDERS = """L AS (
  SELECT CAST(o_orderkey // 20000 AS INTEGER) AS chunk_id, o_orderkey AS row_no,
    'ord cust' || o_custkey || ' k=' || CASE WHEN o_orderkey % 100 < 70 THEN 'a1' WHEN o_orderkey % 100 < 80 THEN 'b2' WHEN o_orderkey % 100 < 90 THEN 'c3' ELSE 'd4' END ||
    ':w' || (o_orderkey % 11) || '/z9 p=' || o_orderpriority || ' ' || o_orderkey AS line
  FROM orders)"""

DOCUMENTS = """L AS (
  SELECT CAST(doc_id // 250 AS INTEGER) AS chunk_id, doc_id * 100000 + i - 1 AS row_no, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""

CLASS = r"""CASE WHEN NOT (contains(tok, '/') OR regexp_matches(tok, '[a-zA-Z]:\\') OR regexp_matches(tok, '\d')) THEN 'lit'
    WHEN regexp_matches(tok, '^[0-9]+$') AND length(tok) <= 15 THEN 'num'
    WHEN regexp_matches(tok, '^[A-Za-z0-9]+$') THEN 'str'
    WHEN regexp_matches(tok, '[A-Za-z0-9]') AND NOT contains(tok, '<>') THEN 'comp'
    WHEN regexp_matches(tok, '[A-Za-z0-9]') THEN 'str' ELSE 'lit' END"""

TOKENS = r"""K AS (SELECT chunk_id, row_no, regexp_extract_all(line, '[^\s|]+|\s|\|') AS toks FROM L)"""
EXPLODED = f"""X AS (SELECT chunk_id, row_no, pos, tok, {CLASS} AS cls
  FROM (SELECT chunk_id, row_no, unnest(toks) AS tok, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos FROM K)),
V AS (SELECT * FROM X WHERE cls <> 'lit')"""
TEMPLATES = """R AS (
  SELECT chunk_id, row_no, string_agg(CASE cls WHEN 'lit' THEN tok WHEN 'num' THEN '<' || chr(CAST(96 + length(tok) AS INTEGER)) || '>' WHEN 'str' THEN '<*>' ELSE '<->' END, '' ORDER BY pos) AS template
  FROM X GROUP BY 1, 2),
TI AS (SELECT chunk_id, template, n AS lines, row_number() OVER (PARTITION BY chunk_id ORDER BY f) - 1 AS template_id
  FROM (SELECT chunk_id, template, count(*) AS n, min(row_no) AS f FROM R GROUP BY 1, 2))"""
NUMBERS = """N AS (SELECT chunk_id, CAST(length(tok) AS INTEGER) AS len, row_no, pos, CAST(tok AS BIGINT) AS value,
    row_number() OVER (PARTITION BY chunk_id, length(tok) ORDER BY row_no, pos) - 1 AS seq FROM V WHERE cls = 'num'),
ND AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY chunk_id, len ORDER BY seq), 0) AS delta FROM N)"""
STRINGS = """S AS (SELECT chunk_id, token, n, row_number() OVER (PARTITION BY chunk_id ORDER BY f) - 1 AS id
  FROM (SELECT chunk_id, tok AS token, count(*) AS n, min(row_no * 1000 + pos) AS f FROM V WHERE cls = 'str' GROUP BY 1, 2))"""
SLOTS = r"""D AS (SELECT chunk_id, tok, count(*) AS n, min(row_no * 1000 + pos) AS f, regexp_replace(tok, '[\p{L}\p{N}]+', '<>', 'g') AS skeleton,
    regexp_extract_all(tok, '[\p{L}\p{N}]+') AS subs FROM V WHERE cls = 'comp' GROUP BY chunk_id, tok),
C AS (SELECT chunk_id, tok, n, f, skeleton, unnest(subs) AS value, CAST(generate_subscripts(subs, 1) - 1 AS INTEGER) AS slot FROM D),
SV AS (SELECT chunk_id, skeleton, slot, value, CAST(sum(n) AS BIGINT) AS cnt, min(f) AS f FROM C GROUP BY 1, 2, 3, 4),
SR AS (SELECT *, (rows // uniq > 1 AND cnt >= rows // uniq AND cnt >= coalesce(before, 0) AND cnt >= coalesce(after, 0)) AS is_rep FROM (
  SELECT *, CAST(sum(cnt) OVER w AS BIGINT) AS rows, count(*) OVER w AS uniq, lag(cnt) OVER o AS before, lead(cnt) OVER o AS after FROM SV
  WINDOW w AS (PARTITION BY chunk_id, skeleton, slot), o AS (PARTITION BY chunk_id, skeleton, slot ORDER BY encode(value)))),
ST AS (SELECT chunk_id, skeleton, slot, any_value(rows) AS rows, any_value(uniq) AS uniq, count(*) FILTER (is_rep) AS n_reps,
    coalesce(list(value ORDER BY encode(value)) FILTER (is_rep), []) AS reps, CAST(coalesce(sum(cnt) FILTER (is_rep), 0) AS BIGINT) AS rep_rows,
    round(coalesce(sum(cnt) FILTER (is_rep), 0) / any_value(rows), 6) AS dominance, round(abs(sum(cnt / rows * log2(cnt / rows))), 6) AS entropy
  FROM SR GROUP BY 1, 2, 3),
B AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, skeleton ORDER BY uniq, rep_rows DESC, entropy, slot) AS rank FROM ST WHERE uniq > 1) WHERE rank = 1)"""
PLAN = r"""P AS (SELECT h.chunk_id, h.skeleton, h.rows, h.n_varying,
    CASE WHEN h.rows = 1 THEN 'single' WHEN n_varying = 0 THEN 'const' WHEN n_varying = 1 THEN 'one'
      WHEN B.n_reps = 0 OR B.n_reps >= 40 OR B.rep_rows / h.rows <= 0.6 THEN 'nosplit' WHEN B.uniq <= 3 THEN 'split_all' ELSE 'split_reps' END AS mode, B.slot AS bs, B.reps
  FROM (SELECT chunk_id, skeleton, any_value(rows) AS rows, count(*) FILTER (uniq > 1) AS n_varying FROM ST GROUP BY 1, 2) h LEFT JOIN B USING (chunk_id, skeleton)),
PV AS (SELECT P.chunk_id, P.skeleton, rows, n_varying, mode, CASE WHEN mode LIKE 'split%' THEN bs END AS best_slot,
    CASE mode WHEN 'split_reps' THEN reps WHEN 'split_all' THEN (SELECT list(value ORDER BY encode(value)) FROM SV WHERE SV.chunk_id = P.chunk_id AND SV.skeleton = P.skeleton AND SV.slot = P.bs) END AS split_values FROM P),
A AS (SELECT D.*, mode, n_varying, best_slot, CASE WHEN list_contains(split_values, subs[best_slot + 1]) THEN subs[best_slot + 1] END AS split_value FROM D JOIN PV USING (chunk_id, skeleton)),
CO AS (SELECT chunk_id, skeleton, slot, min(value) AS constant FROM SV GROUP BY 1, 2, 3 HAVING count(*) = 1),
G AS (SELECT chunk_id, skeleton, split_value, mode, n_varying, best_slot, slot, min(value) AS lo, max(value) AS hi FROM (
  SELECT chunk_id, skeleton, split_value, mode, n_varying, best_slot, unnest(subs) AS value, CAST(generate_subscripts(subs, 1) - 1 AS INTEGER) AS slot FROM A) GROUP BY ALL),
FI AS (SELECT chunk_id, skeleton, split_value, mode, list(word ORDER BY slot) AS fill FROM (
  SELECT G.*, coalesce(constant, CASE WHEN split_value IS NOT NULL AND (slot = best_slot OR n_varying - 1 < 15) AND lo = hi THEN lo END) AS word
  FROM G LEFT JOIN CO USING (chunk_id, skeleton, slot)) GROUP BY 1, 2, 3, 4),
U AS (SELECT A.chunk_id, A.tok, A.skeleton, A.split_value, A.mode, A.n, A.f, string_split_regex(A.tok, '[\p{L}\p{N}]+') AS lits, FI.fill,
    [v for v in list_transform(range(1, len(subs) + 1), lambda i: CASE WHEN FI.fill[i] IS NULL THEN subs[i] END) if v IS NOT NULL] AS vals
  FROM A JOIN FI ON A.chunk_id = FI.chunk_id AND A.skeleton = FI.skeleton AND A.split_value IS NOT DISTINCT FROM FI.split_value),
RU AS (SELECT *, array_to_string(list_transform(range(1, len(fill) + 1), lambda i: lits[i] || coalesce(fill[i], '<>')), '') || lits[len(lits)] AS pattern FROM U),
PC AS (SELECT chunk_id, pattern, col, CASE WHEN min(length(v)) = max(length(v)) THEN CAST(max(length(v)) AS INTEGER) ELSE -1 END AS fixed_len,
    bool_and(regexp_matches(v, '^[0-9]+$')) AS is_num, bool_or(length(v) > 15 OR (length(v) > 1 AND v[1] = '0')) AS lead0_or_big FROM (
  SELECT chunk_id, pattern, unnest(vals) AS v, CAST(generate_subscripts(vals, 1) - 1 AS INTEGER) AS col FROM RU WHERE mode NOT IN ('single', 'const')) GROUP BY 1, 2, 3)"""
INSTANCES = """I AS (SELECT V.chunk_id, V.row_no, V.pos, V.tok, pattern, vals, row_number() OVER (PARTITION BY V.chunk_id, pattern ORDER BY V.row_no, V.pos) - 1 AS inst_no
  FROM V JOIN RU ON V.chunk_id = RU.chunk_id AND V.tok = RU.tok WHERE cls = 'comp' AND len(vals) > 0)"""
JOINED = """J AS (SELECT chunk_id, pattern, inst_no, array_to_string(vals, '') AS joined FROM I JOIN (
    SELECT chunk_id, pattern FROM PC GROUP BY 1, 2 HAVING bool_and(is_num AND fixed_len > 0) AND count(*) >= 2) USING (chunk_id, pattern)),
JN AS (SELECT *, CASE WHEN length(joined) <= 18 THEN try_cast(joined AS BIGINT) END AS value FROM J),
JS AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY chunk_id, pattern ORDER BY inst_no), 0) AS delta FROM JN)"""
IDS = """HD AS (SELECT chunk_id, skeleton, min(f) AS sk FROM RU GROUP BY 1, 2),
PA AS (SELECT RU.chunk_id, pattern, min(sk) AS sk, min(CASE WHEN split_value IS NULL THEN 2 WHEN list_contains(B.reps, split_value) THEN 0 ELSE 1 END) AS part, min(split_value) AS sv, min(f) AS fa
  FROM RU JOIN HD USING (chunk_id, skeleton) LEFT JOIN B USING (chunk_id, skeleton) WHERE mode NOT IN ('single', 'const') GROUP BY 1, 2),
PR AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY sk, part, CASE WHEN part = 0 THEN encode(sv) ELSE encode('') END, fa) AS rank FROM PA),
CE AS (SELECT chunk_id, pattern, f, unnest(vals) AS v, CAST(generate_subscripts(vals, 1) - 1 AS INTEGER) AS col FROM RU WHERE mode NOT IN ('single', 'const')),
OD AS (SELECT chunk_id, pattern AS token, 1 AS block, rank, 0 AS col, 0 AS f FROM PR
  UNION ALL SELECT chunk_id, v, 2, rank, col, f FROM CE JOIN PC USING (chunk_id, pattern, col) JOIN PR USING (chunk_id, pattern)
    WHERE NOT (is_num AND (fixed_len BETWEEN 1 AND 18 OR NOT lead0_or_big)) AND NOT (regexp_matches(v, '^[0-9]+$') AND length(v) <= 15 AND (length(v) = 1 OR v[1] <> '0'))
  UNION ALL SELECT chunk_id, tok, 3, 0, 0, row_no * 1000 + pos FROM V WHERE cls = 'str'
  UNION ALL SELECT RU.chunk_id, tok, 4, 0, 0, sk FROM RU JOIN HD USING (chunk_id, skeleton) WHERE mode IN ('single', 'const')),
DI AS (SELECT chunk_id, token, row_number() OVER (PARTITION BY chunk_id ORDER BY o, encode(token)) - 1 AS id FROM (
  SELECT chunk_id, token, min(struct_pack(a := block, b := rank, c := col, d := f)) AS o FROM OD GROUP BY 1, 2))"""

MATRIX = """SELECT chunk_id, pattern, col, inst_no, coalesce(CASE WHEN (is_num AND (fixed_len BETWEEN 1 AND 18 OR NOT lead0_or_big)) OR (regexp_matches(v, '^[0-9]+$') AND length(v) <= 15 AND (length(v) = 1 OR v[1] <> '0'))
    THEN try_cast(v AS BIGINT) * 2 END, id * 2 + 1) AS code FROM (SELECT chunk_id, pattern, inst_no, unnest(vals) AS v, CAST(generate_subscripts(vals, 1) - 1 AS INTEGER) AS col FROM I)
    JOIN PC USING (chunk_id, pattern, col) LEFT JOIN DI ON DI.chunk_id = PC.chunk_id AND DI.token = v"""
ITEMS = """L AS (
  SELECT CAST((l_orderkey * 10 + l_linenumber) // 200000 AS INTEGER) AS chunk_id, l_orderkey * 10 + l_linenumber AS row_no,
    'item ' || l_orderkey || ':' || l_linenumber || ':' || l_returnflag || ':' || l_linestatus || ':' || strftime(l_shipdate, '%Y:%m:%d') || ':' || CAST(floor(l_quantity) AS BIGINT)
    || ':' || (l_orderkey % 2) || ':' || (l_orderkey % 3) || ':' || (l_orderkey % 5) || ':' || (l_orderkey % 7) || ':' || (l_orderkey % 11)
    || ':' || l_partkey || ':' || l_suppkey || ':' || lpad(CAST(l_orderkey AS VARCHAR), 20, '0') || ':end1 q=' || (l_partkey % 45) || '/s' || (l_suppkey % 50)
    || ' m=' || CASE WHEN l_orderkey % 100 < 70 THEN 'a1' ELSE 'b' || (l_orderkey % 100) END || ':w' || (l_orderkey % 11) AS line FROM lineitem)"""

_BASE = (TOKENS, EXPLODED)
_MINED = (*_BASE, SLOTS, PLAN)


def _sql(lines: str, parts: tuple[str, ...], select: str) -> str:
    return "WITH " + ",\n".join((lines, *parts)) + "\n" + select


def _letters() -> str:
    """Ids of one to three letters, by place; test keys stay below 26^3."""
    return """SELECT p_partkey AS id, CASE
      WHEN p_partkey < 26 THEN chr(CAST(97 + p_partkey AS INTEGER))
      WHEN p_partkey < 702 THEN chr(CAST(97 + (p_partkey - 26) // 26 AS INTEGER)) || chr(CAST(97 + (p_partkey - 26) % 26 AS INTEGER))
      WHEN p_partkey < 18278 THEN chr(CAST(97 + (p_partkey - 702) // 676 AS INTEGER)) || chr(CAST(97 + (p_partkey - 702) // 26 % 26 AS INTEGER)) || chr(CAST(97 + (p_partkey - 702) % 26 AS INTEGER))
      ELSE chr(CAST(97 + (p_partkey - 18278) // 17576 AS INTEGER)) || chr(CAST(97 + (p_partkey - 18278) // 676 % 26 AS INTEGER)) || chr(CAST(97 + (p_partkey - 18278) // 26 % 26 AS INTEGER)) || chr(CAST(97 + (p_partkey - 18278) % 26 AS INTEGER)) END AS letters
    FROM part"""


def oracle_sql() -> dict[str, str]:
    ev, od = EVENTS, ORDERS
    leb = "CAST(greatest(1, ceil(length(bin({v})) / 7.0)) AS INTEGER)"
    sleb = "CAST(ceil(CASE WHEN {v} IN (0, -1) THEN 1 ELSE length(bin(CASE WHEN {v} < 0 THEN -{v} - 1 ELSE {v} END)) + 1 END / 7.0) AS INTEGER)"
    return {
        "template_topk": _sql(ev, (*_BASE, TEMPLATES), "SELECT template, count(*) AS n_lines FROM R GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "tokenize_documents": _sql(DOCUMENTS, (TOKENS,), r"SELECT row_no, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(list_filter(toks, lambda x: regexp_full_match(x, '\s'))) AS INTEGER) AS n_gaps, CAST(length(line) AS INTEGER) AS n_chars FROM K JOIN L USING (chunk_id, row_no)"),
        "token_class_counts": _sql(ev, _BASE, "SELECT cls, count(*) AS n_tokens, count(DISTINCT tok) AS n_distinct FROM X GROUP BY 1"),
        "template_table": _sql(DOCUMENTS.replace("FROM documents))", "FROM documents) WHERE line <> '')"), (*_BASE, TEMPLATES), "SELECT chunk_id, template_id, template, lines FROM TI"),
        "line_templates": _sql(ev, (*_BASE, TEMPLATES), "SELECT chunk_id, row_no, template_id FROM R JOIN TI USING (chunk_id, template)"),
        "template_restore": _sql(ev, (*_BASE, TEMPLATES), "SELECT chunk_id, row_no, template FROM R"),
        "template_usage": _sql(ev, (*_BASE, TEMPLATES), "SELECT chunk_id, template_id, EXISTS (SELECT 1 FROM R WHERE R.chunk_id = TI.chunk_id AND R.template = TI.template) AS used FROM TI"),
        "number_columns_by_length": _sql(od, (*_BASE, NUMBERS), "SELECT chunk_id, len, seq, value FROM N"),
        "number_delta": _sql(od, (*_BASE, NUMBERS), "SELECT chunk_id, len, seq, delta FROM ND"),
        "number_undelta": _sql(od, (*_BASE, NUMBERS), "SELECT chunk_id, len, seq, value FROM N"),
        "number_leb_size": _sql(od, (*_BASE, NUMBERS), f"SELECT chunk_id, len, CAST(sum({leb.format(v='value')}) AS BIGINT) AS raw_bytes, CAST(sum({sleb.format(v='delta')}) AS BIGINT) AS delta_bytes FROM ND GROUP BY 1, 2"),
        "number_mode_choice": _sql(od, (*_BASE, NUMBERS), "SELECT chunk_id, len, CAST(sum(abs(value)) AS BIGINT) AS sum_values, CAST(sum(abs(delta)) AS BIGINT) AS sum_deltas, CASE WHEN sum(abs(delta)) < sum(abs(value)) THEN 'delta' ELSE 'raw' END AS mode FROM ND WHERE seq < 10 GROUP BY 1, 2"),
        "simple_var_dictionary": _sql(od, (*_BASE, STRINGS), "SELECT chunk_id, id, token, n FROM S"),
        "dict_lookup": _sql(od, (*_BASE, STRINGS), "SELECT V.chunk_id, row_no, pos, id FROM V JOIN S ON V.chunk_id = S.chunk_id AND V.tok = S.token WHERE cls = 'str'"),
        "positional_join": _sql(od, _BASE, "SELECT chunk_id, row_no, pos, tok AS token FROM V WHERE cls = 'str'"),
        "skeleton_groups": _sql(ev, (*_BASE, SLOTS), "SELECT chunk_id, skeleton, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_tokens, CAST(min(f) // 1000 AS BIGINT) AS first_row, CAST(min(f) % 1000 AS INTEGER) AS first_pos FROM D GROUP BY 1, 2"),
        "slot_value_counts": _sql(ev, (*_BASE, SLOTS), "SELECT chunk_id, skeleton, slot, value, cnt FROM SV"),
        "slot_stats": _sql(ev, (*_BASE, SLOTS), "SELECT chunk_id, skeleton, slot, rows, uniq, n_reps, dominance, entropy FROM ST"),
        "representative_values": _sql(ev, (*_BASE, SLOTS), "SELECT chunk_id, skeleton, slot, value, cnt FROM SR WHERE is_rep"),
        "best_slot": _sql(ev, (*_BASE, SLOTS), "SELECT chunk_id, skeleton, slot, uniq, n_reps FROM B"),
        "constant_slots": _sql(od, _MINED, "SELECT chunk_id, skeleton, slot, constant FROM CO"),
        "split_plan": _sql(od, _MINED, "SELECT chunk_id, skeleton, rows, n_varying, mode, best_slot, array_to_string(split_values, '|') AS split_values FROM PV"),
        "split_rows_semi": _sql(od, _MINED, "SELECT chunk_id, tok, split_value, n FROM A WHERE split_value IS NOT NULL"),
        "remainder_rows_anti": _sql(od, _MINED, "SELECT chunk_id, tok, n FROM A WHERE mode LIKE 'split%' AND split_value IS NULL"),
        "split_constant_fold": _sql(od, _MINED, "SELECT chunk_id, skeleton, split_value, mode, array_to_string(list_transform(fill, lambda x: coalesce(x, '<>')), '|') AS fill FROM FI"),
        "final_patterns": _sql(od, _MINED, "SELECT chunk_id, pattern, mode, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_tokens, CAST(min(len(vals)) AS INTEGER) AS n_cols FROM RU GROUP BY 1, 2, 3"),
        "pattern_column_types": _sql(ev, _MINED, "SELECT chunk_id, pattern, col, fixed_len, is_num, lead0_or_big FROM PC"),
        "pattern_instance_join": _sql(ev, (*_MINED, INSTANCES), "SELECT chunk_id, pattern, inst_no, tok FROM I"),
        "concat_fixed_width": _sql(ev, (*_MINED, INSTANCES, JOINED), "SELECT chunk_id, pattern, inst_no, joined FROM J"),
        "delta_eligibility": _sql(ev, (*_MINED, INSTANCES, JOINED), """SELECT chunk_id, pattern, count(*) AS rows, max(value) FILTER (inst_no < 10) AS max_value, max(abs(delta)) FILTER (inst_no BETWEEN 1 AND 9) AS max_step,
            coalesce(count(*) >= 2 AND count(*) = count(value) AND max(value) FILTER (inst_no < 10) > 0 AND max(abs(delta)) FILTER (inst_no BETWEEN 1 AND 9) * 10 < max(value) FILTER (inst_no < 10), false) AS eligible FROM JS GROUP BY 1, 2"""),
        "lsb_delta_encode": _sql(ev, (*_MINED, INSTANCES, JOINED), "SELECT chunk_id, pattern, inst_no, CASE WHEN inst_no = 0 THEN value ELSE abs(delta) * 2 + CASE WHEN delta < 0 THEN 1 ELSE 0 END END AS code FROM JS"),
        "lsb_delta_decode": _sql(ev, (*_MINED, INSTANCES, JOINED), "SELECT chunk_id, pattern, inst_no, CAST(joined AS BIGINT) AS value FROM J"),
        "pattern_dictionary": _sql(od, (*_MINED, IDS), "SELECT chunk_id, id, token FROM DI"),
        "matrix_codes": _sql(od, (*_MINED, INSTANCES, IDS), MATRIX),
        "letters_of_id": _letters(),
        "id_of_letters": "SELECT DISTINCT letters, CAST(list_aggregate(list_transform(range(1, length(letters) + 1), lambda i: (ascii(letters[i]) - 96) * CAST(26 ** (length(letters) - i) AS BIGINT)), 'sum') - 1 AS BIGINT) AS id FROM (SELECT event_type AS letters FROM events) WHERE regexp_matches(letters, '^[a-z]+$')",
        "roundtrip_diff": """SELECT 'documents' AS source, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, CAST(0 AS BIGINT) AS n_differ FROM documents UNION ALL SELECT 'events', count(*), 0 FROM events
            UNION ALL SELECT 'orders', count(*), 0 FROM orders UNION ALL SELECT 'pages', CAST(sum(len(string_split(html, chr(10)))) AS BIGINT), 0 FROM pages""",
        "archive_size_by_stream": _sql(od, (*_MINED, TEMPLATES, NUMBERS, INSTANCES, IDS), f"""SELECT 'numbers' AS stream, count(*) AS values, CAST(sum({leb.format(v='value')}) AS BIGINT) AS leb_bytes FROM N
            UNION ALL SELECT 'strings', count(*), CAST(sum({leb.format(v='id')}) AS BIGINT) FROM V JOIN DI ON V.chunk_id = DI.chunk_id AND tok = token WHERE cls = 'str'
            UNION ALL SELECT 'templates', count(*), CAST(sum({leb.format(v='template_id')}) AS BIGINT) FROM R JOIN TI USING (chunk_id, template)
            UNION ALL SELECT 'composites', count(*), CAST(sum({leb.format(v='code')}) AS BIGINT) FROM ({MATRIX})"""),
        "archive_read_chunk": _sql(ev, (), "SELECT chunk_id, row_no, line FROM L WHERE chunk_id = 1"),
        "dictionary_usage": _sql(ev, (*_BASE, STRINGS), """SELECT * FROM (SELECT S.chunk_id, S.id, CASE WHEN bool_or(contains(line, 'PURCHASE')) THEN CASE WHEN bool_or(contains(line, 'CLICK')) THEN 'used' ELSE 'unused' END WHEN bool_or(contains(line, 'CLICK')) THEN 'missing' END AS state
            FROM S JOIN V ON V.chunk_id = S.chunk_id AND V.tok = S.token AND cls = 'str' JOIN L ON L.chunk_id = V.chunk_id AND L.row_no = V.row_no GROUP BY 1, 2) WHERE state IS NOT NULL"""),
        "pattern_uses": _sql(od, _MINED, "SELECT chunk_id, pattern, CAST(sum(n) AS BIGINT) AS uses FROM RU GROUP BY 1, 2"),
        "invalid_templates": _sql(ev, _BASE, """, Q AS (SELECT chunk_id, row_no, string_agg(CASE WHEN cls = 'lit' THEN tok ELSE '<>' END, '' ORDER BY pos) AS shown, string_agg(CASE WHEN cls = 'lit' THEN tok ELSE chr(1) || left(cls, 1) END, '' ORDER BY pos) AS shape FROM X GROUP BY 1, 2),
            Y AS (SELECT chunk_id, shape, row_number() OVER (PARTITION BY chunk_id ORDER BY f) - 1 AS id FROM (SELECT chunk_id, shape, min(row_no) AS f FROM Q GROUP BY 1, 2))
            SELECT chunk_id, row_no, CASE WHEN contains(shown, 'VIEW') THEN '<INVALID_ID:' || id || '>' ELSE shown END AS shown FROM Q JOIN Y USING (chunk_id, shape)""").replace("\n, Q AS", ",\nQ AS"),
        "text_source": _sql(ev, (), "SELECT CAST(n // 4000 AS INTEGER) AS chunk_id, n AS row_no, line FROM (SELECT row_number() OVER (ORDER BY row_no) - 1 AS n, line FROM L)"),
        "row_range": _sql(ev, (), "SELECT chunk_id, row_no, line FROM L WHERE row_no >= 1000 AND row_no < 3000"),
        "sampled_differences": "SELECT 'changed' AS kind, unnest(['before', 'after']) AS side",
        "many_slots_plan": _sql(ITEMS, _MINED, "SELECT chunk_id, skeleton, rows, n_varying, mode, best_slot, array_to_string(split_values, '|') AS split_values FROM PV"),
        "length_keys": _sql(od, (*_BASE, NUMBERS), "SELECT chr(CAST(96 + len AS INTEGER)) AS key, len, count(*) AS n FROM N GROUP BY 1, 2"),
        "legacy_archive_roundtrip": _sql(od, (), "SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY row_no) - 1 AS line_no, line FROM L"),
        "legacy_leb_decode": _sql(od, (*_BASE, NUMBERS), "SELECT chunk_id, len, seq, value FROM N"),
    }
