"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_FILTERS = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT page_id, row_number() OVER () AS r,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT p.r, arg_max(struct_pack(rule := rules.host || rules.path, verdict := rules.verdict), length(rules.host || rules.path)) AS best
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY p.r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (r)
"""

#: Every 50-byte window as hex digits, its first document, and the runs they cover.
SUFFIX_DEDUP = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS win FROM (SELECT doc_id, h, unnest(range(0, greatest(0, n - 49))) AS i FROM b)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (win) WHERE first < doc_id),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, run),
s AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
j AS (SELECT b.doc_id, any_value(n) AS n, sum(z - a) AS gone, count(*) AS runs,
  string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM s JOIN b USING (doc_id) GROUP BY b.doc_id)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN j USING (doc_id)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM t WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN c x ON x.doc_id = a.doc_id JOIN c y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.reach = e.u)
SELECT d.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(r.reach) AS component_id FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
b AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[k : k + least(13, len(ws)) - 1], ' ') AS win FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS k FROM i WHERE len(ws) > 0)),
w AS (SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(0, len(ws) - n + 1) + 1)) AS k FROM d, (SELECT DISTINCT n FROM b))),
m AS (SELECT doc_id, item, k, w.n FROM w JOIN b ON b.win = w.win AND b.n = w.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
"""

#: crc32 of an ASCII text: a table of 256 entries by its rule, then byte by byte.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

BAND_JOIN = f"""
WITH {_CRC_TABLE}, i AS (SELECT item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM items),
l AS (SELECT sale_id, CAST(line_no AS BIGINT) AS line_no, item_id AS line_item_id, CAST(floor(100 * amount + 0.5) AS BIGINT) AS a, CAST(quantity AS BIGINT) AS q, {_CRC.format("CAST(sale_id AS VARCHAR) || ',' || CAST(line_no AS VARCHAR) || ',' || CAST(item_id AS VARCHAR)")} AS w
  FROM sale_lines, crc WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL),
u AS (SELECT *, (2 * a + q - (((2 * a + q) % (2 * q)) + 2 * q) % (2 * q)) // (2 * q) AS u FROM l WHERE q > 0),
m AS (SELECT i.item_id, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, w FROM i JOIN u ON line_item_id <> item_id AND u BETWEEN p - greatest(100, p // 999 + 1) AND p + greatest(100, p // 999 + 1) WHERE abs(u - p) <= 100 OR 1000 * abs(u - p) <= greatest(u, p)),
s AS (SELECT item_id, count(*) AS n_pairs, CAST(sum(gap) AS BIGINT) AS gap_sum, CAST(sum(w) AS BIGINT) AS lines_crc FROM m GROUP BY item_id),
r AS (SELECT item_id, gap, u, sale_id, line_no, line_item_id, row_number() OVER (PARTITION BY item_id ORDER BY gap, u, sale_id, line_no, line_item_id) AS rank FROM m QUALIFY rank <= 2)
SELECT i.item_id, CAST(coalesce(rank, 0) AS INTEGER) AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
FROM i LEFT JOIN s ON s.item_id = i.item_id LEFT JOIN r ON r.item_id = i.item_id
"""


def _clustering(k: int = 40, rounds: int = 5) -> str:
    """Rounds written out: nearest centroid of each vector, then floors of means."""
    fine = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {fine})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v.x) AS x, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v.x, c{n}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), c := c)) AS b FROM v, c{n} GROUP BY r)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT c, list(m ORDER BY i) AS x FROM (SELECT b.c AS c, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{n}, range(1, 65) t(i) GROUP BY b.c, i) GROUP BY c)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = b.c"""


CENTROID_CLUSTERING = _clustering()
