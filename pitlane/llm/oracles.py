"""DuckDB SQL for the numbered queries that SQL can express on whole tables."""

from .urls import BLOCKED_EXPRESSIONS, BLOCKED_WORDS

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_URLS = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule, verdict, on_host, on_path) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
         ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
patterns(pattern, inside) AS (
  VALUES {", ".join(f"('{w}', '(?is)(^|[^a-z0-9])' || '{w.replace('-', '[-_]')}' || '([^a-z0-9]|$)')" for w in BLOCKED_WORDS)},
         {", ".join(f"('{literals}', '{expression}')" for literals, expression in BLOCKED_EXPRESSIONS)}),
best AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, on_path)
  GROUP BY host, path),
hits AS (
  SELECT host, path, min(pattern) AS pattern
  FROM (SELECT DISTINCT host, path FROM parts WHERE host <> '') JOIN patterns ON regexp_matches(host || path, inside)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict, pattern
FROM parts LEFT JOIN best USING (host, path) LEFT JOIN hits USING (host, path)
"""

_SHINGLED = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs WHERE 100 * common >= 85 * (nx + ny - common)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reached.doc_id, sides.y FROM reached JOIN sides ON reached.r = sides.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
"""

_DECONTAMINATED = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, len, win FROM (
    SELECT item, least(len(w), 13) AS len, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS win
    FROM item_words WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM windows),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
spans AS (
  SELECT doc_id, lens.len AS len, unnest(range(1, len(w) - lens.len + 2)) AS i, unnest(list_transform(range(1, len(w) - lens.len + 2), lambda i: array_to_string(w[i:i + lens.len - 1], ' '))) AS win
  FROM doc_words JOIN lens ON len(w) >= lens.len),
hits AS (SELECT s.doc_id, s.i, s.len, w.item FROM spans s JOIN windows w ON s.len = w.len AND s.win = w.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit > 0 AND 20 * h.n_hit >= len(d.w), false) AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""

_DIVERGENCE = rf"""
WITH texts AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM texts),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM texts) GROUP BY lang, term HAVING count(*) >= 30),
occurring AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM texts) GROUP BY lang, source, term),
counts AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN occurring o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
of_groups AS (
  SELECT lang, source, term, n, 1 + CAST((1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS BIGINT) AS p
  FROM counts WINDOW w AS (PARTITION BY lang, source)),
of_langs AS (
  SELECT lang, term, 1 + CAST((1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) WINDOW w AS (PARTITION BY lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM of_groups a JOIN of_groups b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
ranked AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM of_groups p JOIN of_langs q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranked)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 50
"""


def _lloyd(rounds: int, k: int) -> str:
    """Lloyd's rounds one after the other, each with all distances."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS m FROM kept
  ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (SELECT r, c, list_sum(list_transform(range(1, 65), lambda j: (v[j] - m[j]) * (v[j] - m[j]))) AS d FROM kept, c{i}),
a{i} AS MATERIALIZED (SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT c, j, CAST(floor_div AS BIGINT) AS x FROM (
  SELECT c, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
  FROM (SELECT a.c, unnest(v) AS x, unnest(range(64)) AS j FROM kept JOIN a{i} a USING (r)) GROUP BY c, j)),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list(x ORDER BY j) AS m FROM s{i} GROUP BY c) n USING (c))""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (r) JOIN c{rounds} USING (c)
"""


SQL: dict[str, str] = {"op2_url_filter": _URLS, "op9_minhash_near_dedup": _SHINGLED, "op10_decontamination": _DECONTAMINATED, "op11_source_divergence": _DIVERGENCE, "op13_centroids": _lloyd(3, 16)}
