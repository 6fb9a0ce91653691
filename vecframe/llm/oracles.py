"""DuckDB SQL for the rows of operators that SQL can express, from the tables alone."""

from __future__ import annotations

from . import chat

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 99] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w),
l AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM f WHERE r > 1),
g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l),
n AS (SELECT doc_id, run, min(i) AS s, max(i) + 100 AS e FROM g GROUP BY ALL),
p AS (SELECT n.doc_id, s, hex(b[coalesce(lag(e) OVER (PARTITION BY n.doc_id ORDER BY s), 1):s - 1]) AS h FROM n JOIN d USING (doc_id)
  UNION ALL SELECT d.doc_id, 1000000000000, hex(b[coalesce(last, 1):]) FROM d LEFT JOIN (SELECT doc_id, max(e) AS last FROM n GROUP BY doc_id) USING (doc_id)),
k AS (SELECT doc_id, sha256(unhex(string_agg(h, '' ORDER BY s))) AS kept_sha256 FROM p GROUP BY doc_id),
c AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM n GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
h AS (SELECT rn, di.n AS n, i, item FROM di JOIN bw ON di.n = bw.n AND array_to_string(di.w[i:i + di.n - 1], ' ') = bw.s),
p AS (SELECT rn, count(DISTINCT pos) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rn),
t AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM h) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (rn) LEFT JOIN t USING (rn)
"""

LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents),
o AS (SELECT doc_id, ord, line, len(regexp_extract_all(line, '[^\x09-\x0D\x20]+')) AS nw, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i FROM l WHERE regexp_matches(line, '[^\x09-\x0D\x20]')),
x AS (SELECT *, lead(line, 1) OVER p AS l1, lead(line, 2) OVER p AS l2, lead(nw, 1) OVER p AS n1 FROM o WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, i, 3 AS k, line || chr(10) || l1 || chr(10) || l2 AS s FROM x WHERE l2 IS NOT NULL
  UNION ALL SELECT doc_id, i, 2, line || chr(10) || l1 FROM x WHERE nw + n1 >= 50
  UNION ALL SELECT doc_id, i, 1, line FROM x WHERE nw >= 50),
f AS (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY doc_id, i) AS r FROM w),
m AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM f WHERE r > 1),
g AS (SELECT o.doc_id, o.ord, o.i, m.i IS NOT NULL AS gone FROM o LEFT JOIN m ON o.doc_id = m.doc_id AND o.i = m.i),
y AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g),
z AS (SELECT l.doc_id, l.ord, l.line, y.gone AS own, y.begins, coalesce(last_value(y.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.ord ROWS UNBOUNDED PRECEDING), false) AS gone FROM l LEFT JOIN y ON l.doc_id = y.doc_id AND l.ord = y.ord),
a AS (SELECT doc_id, count(*) FILTER (own) AS n_removed, count(*) FILTER (begins) AS n_runs, coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT gone), '') AS kept FROM z GROUP BY doc_id)
SELECT doc_id, n_removed, n_runs, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM a
"""

ORACLES: dict[str, str] = {"op3_chat_format": chat.ORACLE, "op4_suffix_dedup": SUFFIX_DEDUP, "op9_decontaminate": DECONTAMINATE, "op10_line_dedup": LINE_DEDUP}
