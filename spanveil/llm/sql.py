"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from spanveil.llm.quality import STOP_WORDS
from spanveil.llm.sharding import SHARDS, SLOTS, number

W = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0 * source_size AS lim FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS place, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w FROM w
), l AS (
  SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (all_w - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r
), t AS (
  SELECT source, source_size, least(lim, weight * (SELECT arg_min(level, place) FROM l WHERE level <= lim / weight))::DOUBLE AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('42|' || coalesce(d.doc_id::VARCHAR, '␀') || '|' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""


def op5() -> str:
    """The table is filled by recursion: one turn after the other, each taking the
    first free slot of its shard's permutation."""
    prefs = ", ".join(f"({i}, '{s}', {number(f'offset|{s}') % SLOTS}, {number(f'skip|{s}') % (SLOTS - 1) + 1})" for i, s in enumerate(SHARDS))
    n = len(SHARDS)
    return f"""
WITH RECURSIVE shards(i, shard, o, k) AS (VALUES {prefs}),
lists AS (SELECT i, shard, list_transform(range({SLOTS}), lambda j: (o + j * k) % {SLOTS}) AS pref FROM shards),
fill(turn, slot, free) AS (
  SELECT -1, -1::BIGINT, list_transform(range({SLOTS}), lambda x: true)
  UNION ALL
  SELECT turn + 1, pick, list_transform(free, lambda f, x: f AND x - 1 <> pick)
  FROM (SELECT turn, free, list_filter(pref, lambda p: free[p + 1])[1] AS pick FROM fill JOIN lists ON lists.i = (turn + 1) % {n} WHERE turn < {SLOTS - 1})
),
owner AS (SELECT slot, shard FROM fill JOIN shards ON shards.i = turn % {n} WHERE turn >= 0),
d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS})::INT AS slot FROM documents)
SELECT doc_id, d.slot, shard FROM d JOIN owner USING (slot)
"""


OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents
), f AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W}')) AS ls,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop, w FROM d
), g AS (SELECT r, i, w[i:i+2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM f)
), h AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1
), n AS (SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words FROM h GROUP BY r
), x AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, n_stop FROM f LEFT JOIN n USING (r)
), y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 50 AND n_repeat_words / greatest(n_words, 1) <= 0.5 AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 20.0
  AND n_symbols / greatest(n_words, 1) <= 0.1 AND n_stop / greatest(n_words, 1) >= 0.01 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept,
  n_lines, n_stop FROM y
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), b AS (SELECT item_id, {_TERMS} AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id::VARCHAR AS item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i+9])) AS win FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT len(win) AS n FROM items
), runs AS (SELECT r, i, n, w[i:i+n-1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)
), hits AS (SELECT r, i, n, item FROM runs JOIN items USING (win)
), places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), names AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY r
), posts AS (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS p FROM d
), counts AS (SELECT term, count(*) AS n FROM posts GROUP BY term
), terms AS (SELECT DISTINCT item_id::VARCHAR AS item, unnest(w) AS term FROM b
), rare AS (
  SELECT item, term, n, row_number() OVER (PARTITION BY item ORDER BY coalesce(n, 0), term) - 1 AS rank, least(count(*) OVER (PARTITION BY item), 4) AS wanted, min(coalesce(n, 0)) OVER (PARTITION BY item) AS least
  FROM terms LEFT JOIN counts USING (term) WHERE item IS NOT NULL
), lists AS (SELECT * FROM rare WHERE rank < 4 AND least > 0
), near AS (
  SELECT x.r, a.item FROM posts x JOIN lists a ON a.term = x.term AND a.rank = 0 JOIN lists o ON o.item = a.item AND o.rank > 0 JOIN posts y ON y.r = x.r AND y.term = o.term AND abs(y.p - x.p) <= 20
  GROUP BY x.r, a.item, x.p, a.wanted HAVING count(DISTINCT o.rank) = a.wanted - 1
  UNION ALL SELECT x.r, a.item FROM posts x JOIN lists a ON a.term = x.term AND a.wanted = 1
), nears AS (SELECT r, count(DISTINCT item)::BIGINT AS n_near FROM near GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, len(coalesce(items, []))::BIGINT AS n_items,
  sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN places USING (r) LEFT JOIN names USING (r) LEFT JOIN nears USING (r)
"""

OP7 = r"""
WITH l AS (
  SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), d AS (SELECT row_number() OVER () AS r, doc_id FROM documents
), g AS (
  SELECT r, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
    coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '') AS kept
  FROM l LEFT JOIN f USING (key) GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (r)
"""
