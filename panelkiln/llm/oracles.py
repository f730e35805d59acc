"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x
  FROM (SELECT item_id, unnest(CASE WHEN len(w) >= 13 THEN list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS x FROM b)
),
runs AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT doc_id, item_id, s, n FROM runs JOIN windows USING (n, x)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM (SELECT doc_id, unnest(s) AS x FROM sets) a JOIN (SELECT doc_id, unnest(s) AS x FROM sets) b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b
  WHERE 100 * shared >= 80 * (len(x.s) + len(y.s) - shared)
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN component USING (doc_id)
"""


def _op5() -> str:
    from panelkiln.llm.url_filter import RULES, SOFT, SOFT_HITS, STRICT

    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    terms = ", ".join([*(f"('{t}', 1)" for t in SOFT), *(f"('{t}', {SOFT_HITS})" for t in STRICT)])
    return rf"""
WITH r(verdict, host, path) AS (VALUES {rules}),
t(term, weight) AS (VALUES {terms}),
a AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS k FROM pages),
b AS (SELECT page_id, url, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (
  SELECT c.page_id, r.host || r.path AS rule, r.verdict
  FROM c JOIN r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC, r.host) = 1
),
e AS (
  SELECT page_id, sum(weight) AS weight
  FROM c JOIN t ON regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')
  GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, d.rule, coalesce(d.verdict, CASE WHEN e.weight >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN d USING (page_id) LEFT JOIN e USING (page_id)
"""


OP5 = _op5()


def _op13() -> str:
    """Ten rounds, one after the other, each a materialised step."""
    near = (
        "a{0} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(distance := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, cluster := k)) AS near "
        "FROM kept, c{0} GROUP BY vec_id, v, n)"
    )
    means = (
        "m{0} AS (SELECT k, list(floor_div ORDER BY i) AS c FROM (SELECT near.cluster AS k, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div "
        "FROM a{0}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY k), c{1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c)::BIGINT[] AS c FROM c{0} o LEFT JOIN m{0} m ON m.k = o.k)"
    )
    steps = ", ".join(x for i in range(10) for x in (near.format(i), means.format(i, i + 1)))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS n FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64
),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS k, v AS c FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY 1 NULLS LAST, 2 LIMIT 8)),
{steps}, {near.format(10)},
s AS (SELECT near.cluster AS cluster, sum(near.distance)::BIGINT AS cluster_inertia FROM a10 GROUP BY 1)
SELECT vec_id, near.cluster AS cluster, near.distance AS distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM s)::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN s ON s.cluster = near.cluster JOIN c10 ON c10.k = near.cluster
"""


OP13 = _op13()

def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal text, two half bytes at a time."""
    def half(x: str) -> str:
        return f"xor({x} >> 4, {_halves()}[({x} & 15) + 1])"

    step = half(half("xor(a, b)"))
    return f"xor(list_reduce(list_transform(string_split({number}::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda a, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _halves() -> str:
    values = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        values.append(f"{i}::BIGINT")
    return f"[{', '.join(values)}]"


OP12 = rf"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY p) AS own, {_crc32("c")} % 4 AS h FROM t GROUP BY c),
seqs AS (SELECT a.c, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS s FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 20),
members AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth, s FROM seqs),
named AS (SELECT c, n, depth, s[1:depth] AS path FROM members),
nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM named GROUP BY path, depth
),
families AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    (n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.path[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN families f ON f.path = n.path AND f.depth = n.depth
),
above AS (SELECT path[1:d] AS path, d AS depth, saved, n_children = 0 AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own)),
totals AS (SELECT path, depth, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM above GROUP BY 1, 2)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, o.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN totals t ON t.path = o.path AND t.depth = o.depth LEFT JOIN nodes p ON p.depth = o.depth - 1 AND p.path = o.path[1:o.depth - 1]
"""
