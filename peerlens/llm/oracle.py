"""DuckDB SQL for the queries of this package that SQL can express.

The others train models, tokenize or group by similarity; ``tests/llm``
compares them with brute-force versions."""

from __future__ import annotations

OP1 = r"""
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (
  SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw
  FROM parts),
split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts),
rules(rule, verdict, rhost, rpath) AS (VALUES
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/'))
SELECT page_id, host, path,
  (SELECT arg_max(rule, length(rule)) FROM rules
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rule)) FROM rules
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow')
   AS verdict
FROM split
"""

OP10 = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM ints q JOIN ints d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""


def _op12(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds of the exact k-means, one after the other."""
    near = """near{k} AS (
  SELECT vec_id, row_id, part, v, min(d * {entries} + entry) AS best FROM (
    SELECT p.vec_id, p.row_id, p.part, p.v, b.entry, CAST(list_sum(list_transform(
      list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM pieces p JOIN book{k} b USING (part)) GROUP BY ALL)"""
    book = """sums{k} AS (
  SELECT part, best % {entries} AS entry, pos, CAST(sum(v[pos]) AS BIGINT) AS s, count(*) AS n
  FROM near{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM pieces))) AS pos)
  GROUP BY ALL),
new{k} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM sums{k}
  GROUP BY ALL),
book{n} AS (
  SELECT b.part, b.entry, coalesce(x.v, b.v) AS v
  FROM book{k} b LEFT JOIN new{k} x ON x.part = b.part AND x.entry = b.entry)"""
    steps = [s.format(k=k, n=k + 1, entries=entries) for k in range(rounds) for s in (near, book)]
    steps.append(near.format(k=rounds, entries=entries))
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (
  SELECT vec_id, row_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v
  FROM kept, (SELECT unnest(range({parts})) AS part)),
book0 AS (SELECT part, row_id - 1 AS entry, v FROM pieces WHERE row_id <= {entries}),
{(',' + chr(10)).join(steps)},
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM book{rounds}),
coded AS (
  SELECT row_id, string_agg(format('{{:02x}}', best % {entries}), '' ORDER BY part) AS code,
    CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM near{rounds} GROUP BY row_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  codebooks_sha256
FROM coded JOIN kept USING (row_id), digest
"""


OP13 = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
      CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(i))),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS row_id, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
tokens AS (
  SELECT kind, row_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w
  FROM texts),
counts AS (SELECT kind, row_id, w, count(*) AS n FROM tokens GROUP BY ALL),
words AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))),
      lambda k: CAST(('0x' || substr(hex(encode(w)), CAST(2 * k + 1 AS BIGINT), 2)) AS BIGINT))),
      lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM counts), crc_table),
bucketed AS (
  SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t
  FROM counts JOIN words USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM bucketed),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (ss + 10000) AS DOUBLE)
    / CAST((coalesce(s, 0) + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM bucketed, totals),
weighed AS (
  SELECT row_id, sum(n) AS n_features, sum(n * gain) AS weight
  FROM counts JOIN words USING (w) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row_id),
scored AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
    CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST(
      ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5)
      / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM texts LEFT JOIN weighed USING (row_id) WHERE kind = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20
      ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place,
    10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS wanted
  FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= wanted THEN place END AS rank
FROM placed
"""

ORACLES = {"op1_url_filter": OP1, "op10_topk": OP10, "op12_vector_codes": _op12(),
           "op13_resampling": OP13}
