"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
l AS (SELECT DISTINCT host || path AS key FROM p
  WHERE regexp_matches(url, '^[^#]*\\?[^#]*\\butm_source=') AND host || path <> '')
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN host || path IN (SELECT key FROM l) THEN 'block' ELSE 'allow' END AS verdict,
  host || path IN (SELECT key FROM l) AS listed
FROM m
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d
"""

OP5 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 18, 1))) AS pos, words FROM w),
win AS (SELECT doc_id, pos, array_to_string(words[pos : pos + 19], ' ') AS body FROM s),
rep AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS n FROM win) WHERE n > 1),
cov AS (SELECT DISTINCT doc_id, pos + k AS place FROM rep, range(0, 20) AS r(k)),
gone AS (SELECT doc_id, list(place) AS places FROM cov GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN words
    ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

# CRC-32 of a short ASCII string, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, 8 * length({0})),
  lambda i: CASE WHEN i % 8 = 0 THEN ord({0}[i // 8 + 1]) ELSE 0 END)),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"""

OP12 = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS body, turn,
  md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, digest) AS pos FROM t),
lens AS (SELECT c, count(*) AS n, {_CRC32.format("CAST(c AS VARCHAR)")} % 4 AS h FROM t GROUP BY c),
grown AS (SELECT a.c, a.h, a.c - a.c % 20 AS p, least(a.h, coalesce(b.n, 0)) AS k
  FROM lens a LEFT JOIN lens b ON b.c = a.c - a.c % 20),
seq AS (SELECT g.c, r.pos, r.body, r.digest FROM grown g JOIN ranked r ON r.c = g.p AND r.pos <= g.h
  UNION ALL SELECT g.c, r.pos - g.h + g.k, r.body, r.digest FROM grown g JOIN ranked r ON r.c = g.c AND r.pos > g.h),
m AS (SELECT c, pos AS d, md5(array_to_string(list(digest) OVER (PARTITION BY c ORDER BY pos), ',')) AS node,
  len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words FROM seq
  UNION ALL SELECT c, 0, 'root', 0 FROM lens),
linked AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS last FROM m),
nodes AS (SELECT node, min(c) AS c, max(d) AS d, max(up) AS up, max(words) AS words, count(*) AS n,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last), '')) AS ends FROM linked GROUP BY node),
kids AS (SELECT up, count(*) AS n FROM nodes GROUP BY up),
sums AS (SELECT m.node, sum((k.n IS NULL)::BIGINT)::BIGINT AS leaves, sum((x.n - 1) * x.words)::BIGINT AS saved
  FROM nodes x LEFT JOIN kids k ON k.up = x.node JOIN m ON m.c = x.c AND m.d <= x.d GROUP BY m.node)
SELECT x.c AS conv_id, x.d AS depth, p.c AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0) AS n_children,
  s.leaves AS n_leaves, s.saved AS saved_tokens, x.ends AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.node = x.up LEFT JOIN kids k ON k.up = x.node JOIN sums s ON s.node = x.node
"""

ORACLES = {"op1_url_filter": OP1, "op5_substring_dedup": OP5, "op10_exact_dedup": OP10, "op12_prefix_trie": OP12}
