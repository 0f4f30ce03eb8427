"""DuckDB twins of the queries that SQL can express."""

_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""

PREFIX_TRIE = rf"""
WITH t AS (SELECT conv_id, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {_CRC32.format("conv_id")} % 4 AS h FROM t),
  r AS (SELECT c.conv_id, k, digest, n_words FROM c JOIN t ON t.conv_id = c.base AND k < h UNION ALL SELECT c.conv_id, k, digest, n_words FROM c JOIN t USING (conv_id) WHERE k >= h),
  s AS (SELECT conv_id, row_number() OVER w AS d, md5(string_agg(digest, '') OVER w) AS key, n_words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k)
    UNION ALL SELECT conv_id, 0, 'root', 0 FROM c UNION ALL SELECT NULL, 0, 'root', 0),
  p AS (SELECT *, lag(key) OVER w AS parent, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
  n AS (SELECT key, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(conv_id) AS n_convs, any_value(n_words) AS n_words,
    sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY key),
  kids AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
  below AS (SELECT s.key, count_if(kids.key IS NULL) AS n_leaves, CAST(sum((greatest(n.n_convs, 1) - 1) * n.n_words) AS BIGINT) AS saved_tokens
    FROM n LEFT JOIN kids USING (key) JOIN s ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.d <= n.depth GROUP BY 1)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN n AS up ON up.key = n.parent LEFT JOIN kids ON kids.key = n.key JOIN below ON below.key = n.key"""

_HOST_PATH = """SELECT row_number() OVER () AS row, page_id, translate(split_part(hp, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(hp, length(split_part(hp, '/', 1)) + 1) AS path,
    list_sort(list_filter(string_split(CASE WHEN position('?' IN nofrag) > 0 THEN substr(nofrag, position('?' IN nofrag) + 1) ELSE '' END, '&'), lambda q: q <> '' AND NOT starts_with(q, 'utm_'))) AS query
  FROM (SELECT page_id, split_part(split_part(rest, '#', 1), '?', 1) AS hp, split_part(rest, '#', 1) AS nofrag
    FROM (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages))"""


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH u AS ({_HOST_PATH}),
  k AS (SELECT *, regexp_replace(host, ':(80|443)$', '') || rtrim(path, '/') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS own FROM u),
  listed AS (SELECT DISTINCT own FROM k WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
  r(rule_host, rule_path, rule_verdict) AS (VALUES {values}),
  best AS (SELECT row, max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := rule_verdict)) AS b
    FROM k JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row)
SELECT page_id, host, path, b.rule AS rule, listed.own IS NOT NULL AS listed, coalesce(b.verdict, CASE WHEN listed.own IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN best USING (row) LEFT JOIN listed USING (own)"""
