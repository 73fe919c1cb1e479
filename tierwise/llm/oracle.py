"""DuckDB SQL of the document queries that SQL can express."""

from __future__ import annotations

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = r"'[^\x20\x09-\x0D]+'"
ITEM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

REPEATS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {PLAIN}) AS w FROM documents),
pos AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM w)),
rep AS (SELECT doc_id, s FROM pos QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM rep),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

LEAKS = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all({LOW}, {ITEM}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + 9] AS g FROM (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all({LOW}, {ITEM}) AS w FROM documents),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
pos AS (SELECT doc_id, s, n, w[s:s + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes)),
hit AS (SELECT DISTINCT doc_id, s, n, item_id FROM pos JOIN win USING (g)),
cov AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)"""

ARCHIVE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, unhex(sha1(body))::BIT::VARCHAR AS bits,
  min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
       + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, {PLAIN}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, w[s:s + 4] AS g FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pr JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON reach.r = link.x),
low AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(r, w.doc_id) AS component_id,
  coalesce(r, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""

NEGATIVES = """
WITH raw AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT *, row_number() OVER () AS row_no FROM raw),
s AS (SELECT a.row_no AS anchor, a.vec_id AS anchor_id, b.row_no AS other, b.vec_id AS id, a.label = b.label AS alike,
    list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.row_no <> b.row_no WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, anchor_id, other, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor)
WHERE NOT s.alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor, p.other ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10"""

COPIES = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""

# CRC-32 of a feature by a table: bytes of the text in hexadecimal, one step of the fold a byte
RESAMPLED = rf"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
w AS (SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS row_no, regexp_extract_all({LOW}, {ITEM}) AS w FROM documents UNION ALL
  SELECT 1, NULL, 0, regexp_extract_all({LOW}, {ITEM}) FROM benchmark),
feat AS (SELECT kind, row_no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
each AS (SELECT kind, row_no, f, count(*) AS n FROM feat GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM each)),
bucket AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS b FROM hexed, tab),
held AS (SELECT b, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t
  FROM each JOIN bucket USING (f) GROUP BY 1),
total AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM held),
gain AS (SELECT b, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS g FROM held, total),
mean AS (SELECT row_no, sum(n)::BIGINT AS n, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight
  FROM each JOIN bucket USING (f) JOIN gain USING (b) WHERE kind = 0 GROUP BY 1),
noisy AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN mean USING (row_no) WHERE kind = 0),
fit AS (SELECT count(*) AS n FROM noisy WHERE n_words >= 20),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank
FROM placed, fit"""


def sql() -> dict[str, str]:
    return {
        "op5_substring_dedup": REPEATS,
        "op6_benchmark_decontamination": LEAKS,
        "op9_warc": ARCHIVE,
        "op10_minhash_near_dedup": NEAR,
        "op11_hard_negatives": NEGATIVES,
        "op12_exact_dedup": COPIES,
        "op13_importance_resampling": RESAMPLED,
    }
