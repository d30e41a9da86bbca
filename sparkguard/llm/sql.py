"""SQL of the operators on word sets and word sequences, as DuckDB runs it over the whole tables.

Both statements follow the definitions and share nothing with the operators: they join the shingles or stretches themselves and
compare every candidate, where the operators sign, sort and count.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"


def similar_sets(words: int, percent: int, kept: bool = False) -> str:
    """Components of documents whose sets of word n-grams have a Jaccard similarity of ``percent`` or more."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS words FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {words} THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct([array_to_string(words[i:i + {words - 1}], ' ') FOR i IN range(1, len(words) - {words - 2})])) END AS items FROM w),
c AS MATERIALIZED (SELECT row_number() OVER () AS cls, items, len(items) AS n, min(doc_id) AS least FROM s WHERE len(items) > 0 GROUP BY items),
e AS MATERIALIZED (SELECT cls, n, unnest(items) AS item FROM c),
p AS MATERIALIZED (SELECT a.cls AS u, b.cls AS v FROM e a JOIN e b ON a.item = b.item AND a.cls < b.cls AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
    GROUP BY a.cls, b.cls HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
l AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT cls, cls AS other FROM c UNION SELECT r.cls, l.v FROM r JOIN l ON r.other = l.u),
m AS (SELECT r.cls, min(c.least) AS component_id FROM r JOIN c ON r.other = c.cls GROUP BY r.cls),
o AS (SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, CASE WHEN len(s.items) = 0 THEN s.doc_id ELSE m.component_id END AS component_id
    FROM s LEFT JOIN c ON s.items = c.items LEFT JOIN m ON c.cls = m.cls)
SELECT doc_id, n_shingles, component_id{", doc_id = component_id AS kept" if kept else ""} FROM o
"""


#: A run repeats a stretch of 16 words at the distance of its period, since max(24, 3 * q) - q is 16 or more. Where such places follow
#: each other they make one maximal run; of those with equal ends the one with the smallest period counts (its multiples are no smallest ones).
#: Ratios of lengths and periods below 2 ** 26 are told apart, and equal ones found equal, by their doubles.
PERIODIC_RUNS = rf"""
WITH k AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) b(i)),
h AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words,
    xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, k),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM h),
p AS (SELECT *, 1 + (len(words) - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS MATERIALIZED (SELECT rid, doc_id, CASE WHEN a IS NULL THEN words ELSE [words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(len(words))] END AS words FROM p),
g AS (SELECT rid, len(words) AS n, unnest(range(len(words) - 15)) AS i, unnest([array_to_string(words[j:j + 15], ' ') FOR j IN range(1, len(words) - 14)]) AS stretch FROM t WHERE len(words) >= 24),
d AS MATERIALIZED (SELECT rid, n, i, dense_rank() OVER (ORDER BY rid, stretch) AS kind FROM g QUALIFY count(*) OVER (PARTITION BY rid, stretch) > 1),
e AS (SELECT x.rid, x.i, y.i - x.i AS q FROM d x JOIN d y ON x.kind = y.kind AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
f AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e),
s AS (SELECT rid, q, min(i) AS start, max(i) + 16 - min(i) + q AS length FROM f GROUP BY rid, q, island HAVING max(i) + 16 - min(i) + q >= greatest(24, 3 * q)),
r AS (SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length),
b AS (SELECT rid, count(*) AS n_runs, list({{'start': start, 'length': length, 'period': period}} ORDER BY length / period DESC, start, period) AS runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
o AS (SELECT doc_id, coalesce(n_runs, 0) AS n_runs, runs[1] AS best, coalesce(lines, '') AS lines, CASE WHEN runs IS NULL THEN words
    ELSE [words[i + 1] FOR i IN range(len(words)) IF NOT list_bool_or([i >= x.start + x.period AND i < x.start + x.length FOR x IN runs])] END AS words FROM t LEFT JOIN b USING (rid))
SELECT doc_id, n_runs, best.start AS start, best.length AS length, best.period AS period, (1000 * best.length) // best.period AS exponent_milli,
    sha256(lines) AS runs_sha256, sha256(coalesce(array_to_string(words, ' '), '')) AS collapsed_sha256 FROM o
"""
