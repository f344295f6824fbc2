"""DuckDB SQL for the training-data queries that SQL expresses on whole tables: plain statements of what they compute."""

from __future__ import annotations

# Only A-Z become lower case.
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Windows of benchmark items that stand in documents, by equality of their words.
DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
m AS (SELECT doc_id, i, g.k, item_id FROM g JOIN p ON g.k = p.k AND g.s = p.s),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

#: All pairs of documents that share a shingle, and the components of those that are similar enough.
NEAR_DUPLICATES = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a AND r.label < e.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.label AS component_id, m.label = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(label) AS label FROM r GROUP BY node) m ON m.node = doc_id"""

#: All strings of 200 bytes, and the bytes that the repeated ones cover.
REPEATS = """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
s AS (SELECT doc_id, i, b[i + 1:i + 200] AS x FROM (SELECT doc_id, b, unnest(range(0, n - 199)) AS i FROM t WHERE n >= 200)),
r AS (SELECT doc_id, i FROM s WHERE x IN (SELECT x FROM s GROUP BY x HAVING count(*) > 1)),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER w AS before, lead(a) OVER w AS after FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
p AS (SELECT k.doc_id, sum(z - a) AS removed, count(*) AS spans, string_agg(hex(b[before + 1:a]) || CASE WHEN after IS NULL THEN hex(b[z + 1:n]) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN t ON t.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT t.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, CASE WHEN p.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256 FROM t LEFT JOIN p ON t.doc_id = p.doc_id"""

ORACLES = {"op3_fm_index_decontamination": DECONTAMINATION, "op4_minhash_near_duplicates": NEAR_DUPLICATES, "op8_suffix_repeats": REPEATS}
