"""The SQL counterparts, for DuckDB, of those queries of this package that SQL can express."""

from __future__ import annotations

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n - count(*) AS united, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT u, v FROM c WHERE 100 * common >= 80 * united),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.v) AS component_id, s.doc_id = min(r.v) AS kept
FROM s JOIN r ON s.doc_id = r.u GROUP BY s.doc_id, len(s.s)
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, n, t, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + (i // 4) * 5, 5) AS BIGINT) // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest FROM p
), f AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM f
"""


def _kind(order: int, kind: str, pattern: str, value: int, least: int) -> str:
    """Findings of one kind: a match starts after the texts between matches and the matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS o, '{kind}' AS kind, list_sum(list_transform(b[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) AS s, length(m[k]) AS n
  FROM (SELECT doc_id, b, m, v, unnest(range(1, len(m) + 1)) AS k FROM (
    SELECT doc_id, string_split_regex(text, '{quoted}') AS b, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {value}) AS v FROM documents))
  WHERE length(v[k]) >= {least}"""


SECRETS = (
    "WITH f AS ("
    + " UNION ALL ".join(
        [
            _kind(0, "assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
            _kind(1, "access", "AKIA[A-Z0-9]+", 0, 16),
            _kind(2, "hex", "[0-9a-f]+", 0, 32),
        ]
    )
    + """
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, o) AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""
)


def _clusters(k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64) -> str:
    """Rounds one after another; all numbers are whole and small enough for a double."""
    near = "SELECT v.vec_id, v.e, arg_min(c.j, (v.ee - 2 * list_inner_product(v.e, c.c) + c.cc, c.j)) AS j, min(v.ee - 2 * list_inner_product(v.e, c.c) + c.cc) AS d FROM v, {c} c GROUP BY v.id, v.vec_id, v.e"
    parts = [
        f"""v AS (SELECT row_number() OVER () AS id, vec_id, e, list_inner_product(e, e) AS ee FROM (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
          WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}))""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS j, e AS c, ee AS cc FROM v
          WHERE vec_id IS NOT NULL ORDER BY sha256('{seed}:' || vec_id), e LIMIT {k})""",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS ({near.format(c=f'c{i}')})",
            f"""m{i} AS (SELECT j, list(floor(s / n) ORDER BY nth) AS c FROM (
              SELECT j, nth, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(e) AS x, unnest(range({width})) AS nth FROM a{i}) GROUP BY j, nth) GROUP BY j)""",
            f"""c{i + 1} AS (SELECT o.j, coalesce(m.c, o.c) AS c, list_inner_product(coalesce(m.c, o.c), coalesce(m.c, o.c)) AS cc
              FROM c{i} o LEFT JOIN m{i} m ON m.j = o.j)""",
        ]
    parts += [f"a{rounds} AS ({near.format(c=f'c{rounds}')})"]
    return f"""WITH {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in parts)}
      SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
        CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(list_transform(c.c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
      FROM a{rounds} a JOIN c{rounds} c USING (j)"""


COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM documents
), t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM s)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
z AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.m], ' ') JOIN t ON t.lang = c.lang
), b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, array_to_string(w[i : i + q - 1], ' ') AS phrase FROM (
      SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT lang, a, m, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS q FROM f WHERE m > 2)))
  GROUP BY lang, phrase
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n, score
FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 100 * b.a QUALIFY rank <= 2000
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nth FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM d JOIN k USING (id) LEFT JOIN f ON f.key = k.key GROUP BY id, doc_id
"""

ORACLE = {
    "op4_segment_topk": TOPK, "op5_minhash_hamming": NEAR_DEDUP, "op6_warc_chain": WARC, "op7_secret_ledger": SECRETS,
    "op11_literal_centroids": _clusters(), "op12_suffix_collocations": COLLOCATIONS, "op13_hashed_lines": LINES,
}
