"""DuckDB statements of the registered queries."""

from __future__ import annotations

from spanveil.cases import CASES


def split_sql(table: str, doc: str, text: str, left: str, core: str, right: str, keep: str = "true") -> str:
    """Matches with offsets: context is consumed by groups, sentinels are put around the
    value, twice so that two values may share a delimiter, and lengths are summed."""
    pattern = f"{left}({core}){right}"
    put = "'\\1' || chr(1) || '\\2' || chr(2) || '\\3'"
    marked = f"regexp_replace(regexp_replace({text}, '{pattern}', {put}, 'g'), '{pattern}', {put}, 'g')"
    return f"""
WITH m AS (SELECT {doc} AS doc_id, {text} AS t, string_split_regex({marked}, '[' || chr(1) || chr(2) || ']') AS p FROM {table}),
x AS (SELECT doc_id, t, p, unnest(generate_series(2, len(p), 2)) AS i FROM m WHERE len(p) > 1),
y AS (SELECT doc_id, t, coalesce(list_sum(list_transform(p[1:i-1], lambda s: length(s))), 0)::INT AS start_at, p[i] AS value FROM x)
SELECT doc_id, start_at, (start_at + length(value))::INT AS end_at, value FROM y WHERE {keep}
"""


DOC = "doc_id::VARCHAR"
#: A mail address: atoms between dots, at most none of them empty; then labels of letters, digits and
#: inner hyphens; then letters.
EMAIL = ("(^|[^\\pL\\pN_.%+\\x01\\-])", "[\\w%+\\-]+(?:\\.[\\w%+\\-]+)*@(?:[^\\W_]+(?:-+[^\\W_]+)*\\.)+[A-Za-z][A-Za-z]+", "($|[^\\pL\\pN_\\-])")
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_KEEP = (
    "NOT regexp_matches(t[greatest(start_at - 13, 1):start_at], '(?i)\\b(version|ver\\.?|v|clause|section|para(graph)?|schedule|standard|release|rule|article)\\s*$') "
    "AND NOT regexp_matches(t[start_at + length(value) + 1:start_at + length(value) + 16], '(?i)^\\s*(%|million|crore|lakh|kg|mm|km|months?|years?|days?)')"
)
DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
DISTINCT = f"len(list_distinct(string_split({DIGITS}, '')))"
LUHN = f"(list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 1 THEN (2 * substr({DIGITS}, i, 1)::INT) // 10 + (2 * substr({DIGITS}, i, 1)::INT) % 10 ELSE substr({DIGITS}, i, 1)::INT END)) % 10 = 0)"
STRONG = "(regexp_matches(value, '[ -]') OR regexp_matches(t[greatest(start_at - 39, 1):start_at], '(?i)(card|visa|master ?card|amex|debit|credit)'))"
REPEATED = "(" + " OR ".join(f"contains({DIGITS}, repeat('{d}', 6))" for d in range(10)) + ")"


PHONE_KEEP = (
    "NOT regexp_matches(t[greatest(start_at - 2, 1):start_at], '[₹$%]') AND NOT regexp_matches(t[greatest(start_at - 39, 1):start_at], "
    "'(?i)(registration|membership|certificate|licen[cs]e|firm|account|invoice|din|cin|pan)\\s*(no\\.?|number)?\\s*[:\\-]?\\s*$')"
)


def scheme_sql(d: str) -> str:
    n = f"length({d})"
    m = lambda p: f"regexp_matches({d}, '{p}')"
    return (
        f"CASE WHEN {n} IN (13, 16, 19) AND {m('^4')} THEN 'visa' WHEN {n} = 16 AND {m('^(5[1-5]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720))')} THEN 'mastercard' "
        f"WHEN {n} = 15 AND {m('^3[47]')} THEN 'amex' WHEN {n} IN (16, 19) AND {m('^(6011|65|64[4-9])')} THEN 'discover' WHEN {n} = 14 AND {m('^3(0[0-5]|[68])')} THEN 'diners' "
        f"WHEN {n} BETWEEN 16 AND 19 AND {m('^35(2[89]|[3-8])')} THEN 'jcb' WHEN {n} = 16 AND {m('^(60|81|82|508)')} THEN 'rupay' WHEN {n} BETWEEN 12 AND 19 AND {m('^(50|5[6-9]|6)')} THEN 'maestro' END"
    )


def made(value: str, before: str, where: str = "true", table: str = "orders", doc: str = "o_orderkey::VARCHAR") -> str:
    """A value whose place in the made text is known."""
    return f"SELECT {doc} AS doc_id, length({before})::INT AS start_at, (length({before}) + length({value}))::INT AS end_at, {value} AS value FROM {table} WHERE {where}"


def pad(n: str, width: int) -> str:
    return f"lpad(({n})::VARCHAR, {width}, '0')"


SSN = f"{pad('o_custkey % 999', 3)} || '-' || {pad('o_orderkey % 100', 2)} || '-' || {pad('o_custkey * 7 % 10000', 4)}"
DAY = "strftime(o_orderdate, '%d/%m/%Y')"
PAN = f"'ABC' || substr('ABCFGHJLPTXYZ', (o_orderkey % 13 + 1)::INT, 1) || 'K' || {pad('o_custkey % 10000', 4)} || 'Z'"
NAME = "['Arlo', 'Bram', 'Cato', 'Dane'][(o_custkey % 4 + 1)::INT] || ' ' || ['Velden', 'Wexmoor', 'Yardley'][(o_orderkey % 3 + 1)::INT]"
ORG = "['Brenmar', 'Calvex', 'Dorintha'][(o_custkey % 3 + 1)::INT] || ' Foundry Private Limited'"
CLAIMS = """c AS (SELECT (o_orderkey % 300)::VARCHAR AS doc_id, (o_orderkey % 7)::VARCHAR AS key, (o_orderkey % 40)::INT AS start_at, (o_orderkey % 40 + o_orderkey % 11 + 3)::INT AS end_at,
  ['PERSON', 'EMAIL', 'PHONE'][(o_custkey % 3 + 1)::INT] AS pii_type, 'd' || (o_custkey % 4)::VARCHAR AS detector, 0.5 + (o_custkey % 5) / 10 AS confidence, repeat('x', (o_orderkey % 11 + 3)::INT) AS text FROM orders)"""
GOLD = """b AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS key, ['PERSON', 'EMAIL', 'PHONE'][(o_custkey % 3 + 1)::INT] AS pii_type, (o_orderkey % 20)::INT AS s, (o_orderkey % 20 + 5)::INT AS e, o_orderstatus AS stratum FROM orders),
g AS (SELECT key, pii_type, s, e, stratum FROM b WHERE k % 5 <> 0),
p AS (SELECT key, CASE WHEN k % 11 = 0 THEN 'SSN' ELSE pii_type END AS pii_type, s + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS s, e, stratum FROM b WHERE k % 7 <> 0)"""
OVERLAP = "least(g.e, p.e) > greatest(g.s, p.s)"


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN round(({a})::DOUBLE / ({b}), 6) ELSE 0.0 END"
    return f"{rate(tp, f'({tp} + {fp})')} AS precision, {rate(tp, f'({tp} + {fn})')} AS recall, {rate(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS f1"


def counted(match: str) -> str:
    return f"""m AS (SELECT g.pii_type, count(*) AS n FROM g JOIN p ON g.key = p.key AND g.pii_type = p.pii_type AND {match} GROUP BY 1),
t AS (SELECT pii_type, sum(CASE WHEN side = 'p' THEN 1 ELSE 0 END) AS np, sum(CASE WHEN side = 'g' THEN 1 ELSE 0 END) AS ng FROM (SELECT pii_type, 'p' AS side FROM p UNION ALL SELECT pii_type, 'g' FROM g) GROUP BY 1),
c AS (SELECT pii_type, coalesce(n, 0)::BIGINT AS tp, (np - coalesce(n, 0))::BIGINT AS fp, (ng - coalesce(n, 0))::BIGINT AS fn FROM t LEFT JOIN m USING (pii_type)),
each AS (SELECT pii_type, tp, fp, fn, {prf()} FROM c),
pooled AS (SELECT 'MICRO' AS pii_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c)"""


STRICT = "g.s = p.s AND g.e = p.e"
RUNS = "r AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey::VARCHAR AS key, unnest([0, 1, 2]) AS run_ix, o_orderstatus FROM orders)"
TABLE = "x AS (SELECT (l_orderkey % 50)::VARCHAR AS doc_id, l_orderkey AS table_index, l_linenumber - 1 AS row_index, unnest([0, 1, 2]) AS col_index, unnest([l_partkey::VARCHAR, l_suppkey::VARCHAR, l_returnflag]) AS text FROM lineitem)"

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cases_sql() -> str:
    rows = ", ".join(f"({i}, {quoted(t)}, {'true' if h else 'false'}, {quoted(k)}, {quoted(v)})" for i, (t, h, found) in enumerate(CASES) for k, v in found)
    return f"""
WITH c(i, t, cell, pii_type, value) AS (VALUES {rows}),
x AS (SELECT o_orderkey::VARCHAR AS doc_id, pii_type, value, CASE WHEN cell THEN t ELSE 'No ' || o_orderkey::VARCHAR || ': ' || t END AS t FROM orders JOIN c ON o_orderkey % {len(CASES)} = c.i)
SELECT doc_id, (strpos(t, value) - 1)::INT AS start_at, (strpos(t, value) - 1 + length(value))::INT AS end_at, pii_type, value FROM x
"""


#: The fold over the claims of a segment: each meets the accepted ones in order and is kept, cut or dropped.
CUT = """CASE WHEN x.s < 0 OR x.s >= a.e OR a.s >= x.e THEN x WHEN x.s >= a.s AND x.e <= a.e THEN {'s': -1, 'e': -1, 't': x.t}
  WHEN a.s - x.s >= x.e - a.e THEN CASE WHEN a.s - x.s >= 3 THEN {'s': x.s, 'e': a.s, 't': x.t} ELSE {'s': -1, 'e': -1, 't': x.t} END
  ELSE CASE WHEN x.e - a.e >= 3 THEN {'s': a.e, 'e': x.e, 't': x.t} ELSE {'s': -1, 'e': -1, 't': x.t} END END"""
RESOLVED = f"""RECURSIVE {CLAIMS},
merged AS (SELECT doc_id, key, start_at, end_at, pii_type, string_agg(DISTINCT detector, '+' ORDER BY detector) AS detector, max(confidence) AS confidence FROM c WHERE confidence >= 0.6 GROUP BY 1, 2, 3, 4, 5),
ranked AS (SELECT doc_id, key, {{'s': start_at, 'e': end_at, 't': pii_type}} AS x,
  row_number() OVER (PARTITION BY doc_id, key ORDER BY CASE pii_type WHEN 'EMAIL' THEN 10 WHEN 'PHONE' THEN 40 ELSE 80 END, start_at - end_at, start_at, -confidence, detector) AS place FROM merged),
folded AS (
  SELECT doc_id, key, 1 AS place, [x] AS taken FROM ranked WHERE place = 1
  UNION ALL
  SELECT f.doc_id, f.key, f.place + 1, list_filter(list_append(f.taken, list_reduce(f.taken, lambda x, a: {CUT}, r.x)), lambda y: y.s >= 0)
  FROM folded f JOIN ranked r ON r.doc_id = f.doc_id AND r.key = f.key AND r.place = f.place + 1
),
resolved AS (SELECT doc_id, key, unnest(taken, recursive := true) FROM folded QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY place DESC) = 1)"""
PERMUTATION = "1576283094"


def permutations() -> str:
    """The eight powers of the permutation, one after the other."""
    rows = ["0123456789"]
    while len(rows) < 8:
        rows.append("".join(PERMUTATION[int(x)] for x in rows[-1]))
    return "".join(rows)


TURNED = "((CASE WHEN a < 5 THEN a + b ELSE a - b + 10 END) % 5 + CASE WHEN (a < 5) <> (b < 5) THEN 5 ELSE 0 END)"
VERHOEFF = f"""WITH b AS (SELECT o_orderkey, reverse('2' || {pad('o_orderkey', 10)} || '0') AS t FROM orders),
f AS (SELECT o_orderkey, list_reduce(list_transform(range(0, 12), lambda i: substr('{permutations()}', ((i % 8) * 10 + substr(t, i + 1, 1)::INT + 1)::INT, 1)::INT), lambda a, b: {TURNED}, 0) AS c FROM b)
SELECT o_orderkey, (CASE WHEN c < 5 THEN (5 - c) % 5 ELSE c END)::INT AS digit FROM f"""
FIRST = "['Arlo', 'Bram', 'Cato', 'Dane'][(o_custkey % 4 + 1)::INT]"
#: Documents that introduce a name, and the order texts in which its forms stand.
NAMES = f"""n AS (SELECT DISTINCT o_custkey, {FIRST} AS first FROM orders WHERE o_orderkey % 2 = 0),
h AS (SELECT o_custkey::VARCHAR AS doc_id, o_custkey::VARCHAR || '/' || o_orderkey::VARCHAR AS key, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [{{'s': 4, 'n': length(first) + 7, 'c': 0.95}}] ELSE [{{'s': 5, 'n': 6, 'c': 0.72}}, {{'s': 16, 'n': length(first) + 7, 'c': 0.95}}] END) AS m FROM orders JOIN n USING (o_custkey))"""
SHAPE = "regexp_replace({}, '[0-9]', '9', 'g')"

SQL: dict[str, str] = {
    "resolve_greedy": f"WITH {RESOLVED} SELECT doc_id, key, s AS start_at, e AS end_at, t AS pii_type FROM resolved",
    "resolve_stats": f"""WITH {RESOLVED}, k AS (SELECT count(*) AS n FROM c WHERE confidence >= 0.6), m AS (SELECT count(*) AS n FROM merged), r AS (SELECT count(*) AS n FROM resolved),
z AS (SELECT count(*) AS n FROM resolved y WHERE NOT EXISTS (SELECT 1 FROM merged x WHERE x.doc_id = y.doc_id AND x.key = y.key AND x.start_at = y.s AND x.end_at = y.e AND x.pii_type = y.t))
SELECT (SELECT count(*) FROM c) AS n_input, (SELECT count(*) FROM c) - k.n AS n_low_confidence, k.n - m.n AS n_duplicates, m.n - r.n AS n_dropped, z.n AS n_truncated, r.n AS n_output FROM k, m, r, z""",
    "gazetteer_sweep": f"WITH {NAMES} SELECT doc_id, key, m.s::INT AS start_at, (m.s + m.n)::INT AS end_at, m.c::DOUBLE AS confidence FROM h",
    "gazetteer_sweep_ngrams": f"WITH {NAMES} SELECT doc_id, key, m.s::INT AS start_at, (m.s + m.n)::INT AS end_at FROM h",
    "gazetteer_build": f"WITH {NAMES} SELECT o_custkey::VARCHAR AS scope, lower(first) || ' velden' AS key, 'PERSON' AS pii_type, '' AS parent_key, false AS derived FROM n UNION ALL SELECT o_custkey::VARCHAR, 'velden', 'PERSON', lower(first) || ' velden', true FROM n",
    "canonical_chain": f"WITH {NAMES} SELECT lower(first) || ' velden' AS canonical_key, 2 * count(*) AS n FROM n GROUP BY 1",
    "detector_cases": cases_sql(),
    "resolved_cases": cases_sql(),
    "stream_cases": cases_sql(),
    "detector_counts_of_cases": f"SELECT pii_type, count(*) AS n FROM ({cases_sql()}) GROUP BY 1",
    "email_spans": split_sql("documents", DOC, "text", *EMAIL),
    "email_spans_pages": split_sql("pages", "page_id::VARCHAR", "html", *EMAIL),
    "ipv4_spans": split_sql("documents", DOC, "text", "(^|[^\\pL\\pN_.\\x01\\-])", f"(?:{OCTET}\\.){{3}}{OCTET}", "($|\\.$|\\.[^0-9]|[^\\pL\\pN_.\\-])", IP_KEEP),
    "ipv6_spans": made("'2001:db8::' || lower(to_hex(o_orderkey % 65536))", "'peer '"),
    "phone_country_spans": split_sql("documents", DOC, "text", "(^|[^\\pL\\pN_+\\x01])", "\\+[1-9](?:[ .()\\-]{0,2}[0-9]){7,14}", "($|[^0-9])", f"length({DIGITS}) BETWEEN 8 AND 15 AND {DISTINCT} > 2 AND {PHONE_KEEP}"),
    "card_spans": split_sql("documents", DOC, "text", "(^|[^0-9.\\x01\\-])", "[0-9](?:[ \\-]?[0-9]){11,18}", "($|[.\\-]$|[.\\-][^0-9]|[^0-9.\\-])",
                            f"{LUHN} AND {scheme_sql(DIGITS)} IS NOT NULL AND ({STRONG} OR (length(value) IN (15, 16) AND {DISTINCT} >= 4 AND NOT {REPEATED}))"),
    "card_schemes": f"WITH d AS (SELECT rpad(['4', '51', '2720', '6011', '3528', '9'][(o_orderkey % 6 + 1)::INT] || o_custkey::VARCHAR, 16, '0') AS d FROM orders) SELECT {scheme_sql('d')} AS scheme, count(*) AS n FROM d GROUP BY 1",
    "luhn_valid": f"SELECT o_orderkey, {LUHN} AS valid FROM (SELECT o_orderkey, '411111' || {pad('o_orderkey', 10)} AS value FROM orders)",
    "verhoeff_valid": VERHOEFF,
    "ssn_spans": made(SSN, "'Case ' || o_orderkey::VARCHAR || ' SSN '", "o_custkey % 999 NOT IN (0, 666) AND o_custkey % 999 < 900 AND o_orderkey % 100 <> 0 AND o_custkey * 7 % 10000 <> 0"),
    "dob_spans": made(DAY, "'Clerk ' || o_custkey::VARCHAR || ', Date of Birth: '"),
    "dob_contextual_spans": made("strftime(o_orderdate, '%Y-%m-%d')", "'She was born in Leeds, '"),
    "pan_spans": made(PAN, "'Quoted '", "o_orderkey % 13 < 10"),
    "labelled_id_spans": made(pad("o_custkey", 8), "'DIN: '", "o_orderkey % 2 = 0"),
    "column_header_ids": made(pad("o_custkey", 8), "''"),
    "url_spans": made("'https://www.host' || (o_custkey % 97)::VARCHAR || '.example.com/p/' || o_orderkey::VARCHAR", "'see '", "o_orderkey % 2 = 0"),
    "url_hosts": "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(replace(url, ' ', '')), '^[a-z]+://', ''), '[/?#].*$', ''), '^www\\.', '') AS host FROM pages",
    "person_honorific": made(NAME, "'Signed by Mr. '"),
    "person_column_header": made("'Arlo ' || ['Velden', 'Road', 'Yardley'][(o_orderkey % 3 + 1)::INT]", "''", "o_orderkey % 3 <> 1"),
    "org_suffix": made(ORG, "'sold to '"),
    "address_pin": made(f"'Plot ' || (o_custkey % 90 + 1)::VARCHAR || ', Cedar Road, Pune - 411 ' || {pad('o_orderkey % 1000', 3)}", "'Address: '"),
    "name_hint_from_email": "SELECT o_orderkey, ['Arlo Velden', NULL, 'Bram Wexmoor', NULL][(o_orderkey % 4 + 1)::INT] AS hint FROM orders",
    "norm_keys": "SELECT c_custkey, '\"' || lower(c_name) || '\" - ' || lower(c_mktsegment) AS k FROM customer",
    "case_styles": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'lower' WHEN c_mktsegment = upper(c_mktsegment) THEN 'upper' ELSE 'title' END AS style FROM customer",
    "short_forms": "SELECT o_orderkey, ['Velden', 'Bram Wexmoor|Wexmoor', ''][(o_orderkey % 3 + 1)::INT] AS forms FROM orders",
    "brand_forms": "SELECT o_orderkey, ['Brenmar Foundry', 'BFX Calvex|BFX', ''][(o_orderkey % 3 + 1)::INT] AS forms FROM orders",
    "confidence_floor": f"WITH {CLAIMS} SELECT pii_type, count(*) AS n FROM c WHERE confidence >= 0.6 GROUP BY 1",
    "merge_duplicates": f"WITH {CLAIMS} SELECT doc_id, key, start_at, end_at, pii_type, string_agg(DISTINCT detector, '+' ORDER BY detector) AS detector, round(max(confidence), 4)::DOUBLE AS confidence FROM c GROUP BY 1, 2, 3, 4, 5",
    "disjointness_check": f"WITH {RESOLVED} SELECT doc_id, key, count(*) AS n, sum(e - s)::BIGINT AS characters, 0::BIGINT AS n_overlapping FROM resolved GROUP BY 1, 2",
    "leak_check": "SELECT doc_id, 0::BIGINT AS n_leaks FROM (SELECT doc_id::VARCHAR AS doc_id FROM documents)",
    "leaks_known": "WITH o AS (SELECT (o_custkey % 200)::VARCHAR AS doc_id, o_orderkey::VARCHAR AS key, o_custkey AS c, o_orderkey AS k FROM orders), v AS (SELECT DISTINCT doc_id, 'Zorvex' || (c % 50)::VARCHAR AS original FROM o) "
                   "SELECT o.doc_id, o.key, v.original FROM o JOIN v ON o.doc_id = v.doc_id AND contains(CASE WHEN k % 3 = 0 THEN 'kept Zorvex' || (c % 50)::VARCHAR || ' here' ELSE 'gone' END, v.original)",
    "card_surrogate_luhn": f"SELECT DISTINCT v AS original, {SHAPE.format('v')} AS shape, '41' AS lead, true AS valid, true AS other FROM (SELECT '4111-11' || {pad('o_orderkey % 100', 2)} || '-1111-' || {pad('o_custkey % 10000', 4)} AS v FROM orders)",
    "ssn_surrogate": f"SELECT DISTINCT v AS original, {SHAPE.format('v')} AS shape, true AS valid, true AS other FROM (SELECT {pad('o_custkey % 600 + 100', 3)} || '-12-' || {pad('o_orderkey % 9999 + 1', 4)} AS v FROM orders)",
    "phone_surrogate": f"SELECT DISTINCT v AS original, {SHAPE.format('v')} AS shape, '+91' AS lead, true AS valid, true AS other FROM (SELECT '+91 98765 ' || {pad('o_custkey % 100000', 5)} AS v FROM orders)",
    "surrogate_uniqueness": "SELECT 'p' || c_custkey::VARCHAR AS canonical_key, 1::BIGINT AS holders FROM customer",
    "digit_substitution": "SELECT o_orderkey, '(' || d[1:2] || ') ' || d[3:4] || '-' || d[5:6] || ' ' || d[7:9] AS filled FROM (SELECT o_orderkey, rpad(o_custkey::VARCHAR, 9, '0') AS d FROM orders)",
    "run_offset_map": f"WITH {RUNS} SELECT doc_id, key, run_ix, [0, 8, 14][run_ix + 1] AS start_at, [8, 14, 14 + length('mple.org for ') + length(o_orderstatus)][run_ix + 1]::INT AS end_at FROM r",
    "run_overlap_rewrite": f"WITH {RUNS} SELECT doc_id, key, run_ix, ['Mail [MAIL]', '', ' for ' || o_orderstatus][run_ix + 1] AS new_text FROM r",
    "section_carry_forward": "SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS seq, coalesce(last_value(CASE WHEN o_orderkey % 5 = 0 THEN 't' || o_orderkey::VARCHAR END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM orders",
    "table_header_attach": f"WITH {TABLE} SELECT table_index, row_index, col_index, CASE WHEN row_index > 0 THEN coalesce(max(CASE WHEN row_index = 0 THEN text END) OVER (PARTITION BY doc_id, table_index, col_index), '') ELSE '' END AS column_header, CASE WHEN col_index > 0 THEN coalesce(max(CASE WHEN col_index = 0 THEN text END) OVER (PARTITION BY doc_id, table_index, row_index), '') ELSE '' END AS row_header FROM x",
    "merged_cell_dedupe": "WITH x AS (SELECT (l_orderkey % 50)::VARCHAR AS doc_id, (l_partkey % 40)::VARCHAR AS cell_path, l_orderkey::INT AS row_index, l_linenumber AS col_index FROM lineitem) SELECT doc_id, cell_path, row_index, col_index FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, cell_path ORDER BY row_index, col_index) = 1",
    "doc_stats": "SELECT kind, count(*) AS segments, sum(length(t))::BIGINT AS characters FROM (SELECT 'paragraph' AS kind, text AS t FROM documents UNION ALL SELECT 'turn', text FROM conversations UNION ALL SELECT 'html', html FROM pages) GROUP BY 1",
    "cell_segments": "SELECT c_custkey::VARCHAR AS doc_id, 0::BIGINT AS seq, c_name AS text, 'c_name' AS column_header FROM customer UNION ALL SELECT c_custkey::VARCHAR, 1, c_mktsegment, 'c_mktsegment' FROM customer",
    "strict_match": f"WITH {GOLD} SELECT g.key, g.pii_type, g.s AS g_start, g.e AS g_end FROM g JOIN p ON g.key = p.key AND g.pii_type = p.pii_type AND {STRICT}",
    "relaxed_match": f"WITH {GOLD} SELECT g.key, g.pii_type, g.s AS g_start, g.e AS g_end, p.s AS p_start, p.e AS p_end FROM g JOIN p ON g.key = p.key AND g.pii_type = p.pii_type AND {OVERLAP}",
    "relaxed_match_many": """WITH RECURSIVE b AS (SELECT (o_custkey % 400)::VARCHAR AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'PERSON' ELSE 'EMAIL' END AS pii_type, o_orderkey AS k FROM orders),
g AS (SELECT DISTINCT key, pii_type, (k * 7 % 60)::INT AS s, (k * 7 % 60 + 5 + k % 6)::INT AS e FROM b), p AS (SELECT DISTINCT key, pii_type, (k * 11 % 60)::INT AS s, (k * 11 % 60 + 4 + k % 6)::INT AS e FROM b),
pairs AS (SELECT g.key, g.pii_type, {'gs': g.s, 'ge': g.e, 'ps': p.s, 'pe': p.e} AS x, row_number() OVER (PARTITION BY g.key, g.pii_type ORDER BY greatest(g.s, p.s) - least(g.e, p.e), g.s, g.e, p.s, p.e) AS place
  FROM g JOIN p ON g.key = p.key AND g.pii_type = p.pii_type AND least(g.e, p.e) > greatest(g.s, p.s)),
folded AS (SELECT key, pii_type, 1 AS place, [x] AS taken FROM pairs WHERE place = 1
  UNION ALL SELECT f.key, f.pii_type, f.place + 1, CASE WHEN len(list_filter(f.taken, lambda y: (y.gs = r.x.gs AND y.ge = r.x.ge) OR (y.ps = r.x.ps AND y.pe = r.x.pe))) > 0 THEN f.taken ELSE list_append(f.taken, r.x) END
  FROM folded f JOIN pairs r ON r.key = f.key AND r.pii_type = f.pii_type AND r.place = f.place + 1)
SELECT key, pii_type, gs AS g_start, ge AS g_end, ps AS p_start, pe AS p_end FROM (SELECT key, pii_type, unnest(taken, recursive := true) FROM folded QUALIFY row_number() OVER (PARTITION BY key, pii_type ORDER BY place DESC) = 1)""",
    "prf_strict": f"WITH {GOLD}, {counted(STRICT)} SELECT * FROM each UNION ALL SELECT pii_type, tp, fp, fn, {prf()} FROM pooled",
    "prf_relaxed": f"WITH {GOLD}, {counted(OVERLAP)} SELECT * FROM each UNION ALL SELECT pii_type, tp, fp, fn, {prf()} FROM pooled UNION ALL SELECT 'MACRO', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM each WHERE tp + fn > 0",
    "char_confusion": f"""WITH {GOLD}, o AS (SELECT sum(least(g.e, p.e) - greatest(g.s, p.s))::BIGINT AS tp FROM g JOIN p ON g.key = p.key AND {OVERLAP}),
n AS (SELECT tp, ((SELECT sum(e - s) FROM p) - tp)::BIGINT AS fp, ((SELECT sum(e - s) FROM g) - tp)::BIGINT AS fn, (SELECT 40 * count(*) FROM b) AS n FROM o)
SELECT tp, fp, fn, (n - tp - fp - fn)::BIGINT AS tn, round((n - fp - fn) / n, 6) AS accuracy FROM n""",
    "segment_confusion": f"""WITH {GOLD}, f AS (SELECT k % 5 <> 0 AS g, k % 7 <> 0 AS p FROM b),
n AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM f)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM n""",
    "by_stratum": f"""WITH {GOLD}, m AS (SELECT g.stratum, count(*) AS tp FROM g JOIN p ON g.key = p.key AND g.pii_type = p.pii_type AND {STRICT} GROUP BY 1),
c AS (SELECT stratum, tp, ((SELECT count(*) FROM p WHERE p.stratum = m.stratum) - tp)::BIGINT AS fp, ((SELECT count(*) FROM g WHERE g.stratum = m.stratum) - tp)::BIGINT AS fn FROM m)
SELECT stratum, tp, fp, fn, {prf()} FROM c""",
    "error_rows_strict": f"WITH {GOLD} SELECT 'FN' AS error, key, pii_type, s AS start_at, e AS end_at FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE g.key = p.key AND g.pii_type = p.pii_type AND {STRICT}) UNION ALL SELECT 'FP', key, pii_type, s, e FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.key = p.key AND g.pii_type = p.pii_type AND {STRICT})",
    "error_rows_relaxed": f"WITH {GOLD} SELECT 'FN' AS error, key, pii_type, s AS start_at, e AS end_at FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE g.key = p.key AND g.pii_type = p.pii_type AND {OVERLAP}) UNION ALL SELECT 'FP', key, pii_type, s, e FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.key = p.key AND g.pii_type = p.pii_type AND {OVERLAP})",
    "missing_gold_values": "SELECT c_custkey::VARCHAR AS key, 'ORGANIZATION' AS pii_type, 'BUILDING' AS text FROM customer WHERE c_custkey % 2 = 0 AND NOT contains(c_name || ' in ' || c_mktsegment, 'BUILDING')",
    "skipped_replacements": "SELECT o_custkey::VARCHAR AS doc_id, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderkey % 2 <> 0",
    "type_confusion": f"WITH {GOLD} SELECT g.pii_type, p.pii_type AS predicted, count(*) AS n FROM g JOIN p ON g.key = p.key AND g.pii_type <> p.pii_type AND {OVERLAP} GROUP BY 1, 2",
    "boundary_errors": f"WITH {GOLD} SELECT g.key, g.pii_type, g.s AS g_start, g.e AS g_end, p.s AS p_start, p.e AS p_end FROM g JOIN p ON g.key = p.key AND g.pii_type = p.pii_type AND {OVERLAP} AND NOT ({STRICT})",
    "stratified_sample": "SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS stratum FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('20260925|' || o_orderkey::VARCHAR), o_orderkey::VARCHAR) <= CASE o_orderstatus WHEN 'F' THEN 40 WHEN 'O' THEN 45 ELSE 1000000000 END OR o_orderkey IN (1, 2)",
    "unknown_keys": f"WITH {GOLD} SELECT key, pii_type FROM g WHERE stratum = 'F'",
    "nth_occurrence": "SELECT c_custkey, (list_filter(range(1, length(s)), lambda i: substr(s, i, 2) = '00')[3] - 1)::INT AS at FROM (SELECT c_custkey, c_name || c_mktsegment AS s FROM customer)",
    "synthetic_scores": "SELECT 'MICRO' AS pii_type, 20::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1",
    "ner_people": made(NAME, "'Signed by Mr. '"),
    "topk_per_type": f"WITH {CLAIMS}, d AS (SELECT DISTINCT pii_type, text || doc_id AS text FROM c) SELECT pii_type, text, rank::INT AS rank FROM (SELECT pii_type, text, row_number() OVER (PARTITION BY pii_type ORDER BY length(text) DESC, text) AS rank FROM d) WHERE rank <= 14",
}
