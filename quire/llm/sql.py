"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix/' || doc_id::VARCHAR) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM k),
v AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap))::BIGINT::DOUBLE
            / (sum(weight) OVER () - (sum(weight) OVER o - weight))::BIGINT::DOUBLE AS level
  FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
l AS (SELECT arg_min(level, ratio) AS level FROM v WHERE level <= ratio),
g AS (
  SELECT source, source_size, CASE WHEN ratio < coalesce(l.level, ratio + 1) THEN cap::DOUBLE ELSE l.level * weight END AS target
  FROM v, l),
q AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key)::BIGINT AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
f AS (
  SELECT doc_id, size, source, key, (upto + r * source_size)::DOUBLE / target AS finish
  FROM q, range(3) p(r) WHERE size > 0 AND target > 0),
u AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source IS NULL, source, key) AS run FROM f),
t AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM u WHERE run <= (SELECT sum(size) FROM d) GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN t USING (doc_id)
"""

OP4 = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP6 = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns,
         list(md5(role || chr(31) || text) ORDER BY turn NULLS FIRST, role, text) AS key,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS spoken
  FROM t GROUP BY 1),
k AS (SELECT *, (row_number() OVER (ORDER BY key, conv_id) - 1) // 2 AS pair FROM c),
p AS (SELECT list({'id': conv_id, 'turns': turns} ORDER BY spoken DESC, conv_id) AS p FROM k GROUP BY pair),
q AS (SELECT p[1].id AS chosen_id, p[1].turns AS ct, p[2].id AS rejected_id, p[2].turns AS rt FROM p),
n AS (
  SELECT *, CASE WHEN rt IS NULL
      THEN len([i FOR i IN range(1, len(ct) + 1) IF len([x FOR x IN ct[1:i] IF x.role = 'assistant']) = 0])
      ELSE len([i FOR i IN range(1, least(len(ct), len(rt)) + 1) IF ct[1:i] = rt[1:i]]) END AS n
  FROM q),
r AS (
  SELECT chosen_id, rejected_id, n,
         ['<|' || x.role || '|>' || chr(10) || replace(x.text, '<|', '< |') || '<|end|>' || chr(10) FOR x IN ct] AS cr,
         ['<|' || x.role || '|>' || chr(10) || replace(x.text, '<|', '< |') || '<|end|>' || chr(10) FOR x IN rt] AS rr, ct, rt
  FROM n)
SELECT chosen_id, rejected_id, n::BIGINT AS n_shared, array_to_string(cr[1:n], '') AS prompt, array_to_string(cr[n + 1:], '') AS chosen,
       CASE WHEN rt IS NOT NULL THEN array_to_string(rr[n + 1:], '') END AS rejected,
       array_to_string([(length(array_to_string(cr[n + 1:i - 1], '')) + length(ct[i].role) + 5)::VARCHAR || '-' ||
                        (length(array_to_string(cr[n + 1:i], '')) - 1)::VARCHAR
                        FOR i IN range(n + 1, len(ct) + 1) IF ct[i].role = 'assistant'], ',') AS chosen_mask,
       CASE WHEN rt IS NOT NULL THEN
       array_to_string([(length(array_to_string(rr[n + 1:i - 1], '')) + length(rt[i].role) + 5)::VARCHAR || '-' ||
                        (length(array_to_string(rr[n + 1:i], '')) - 1)::VARCHAR
                        FOR i IN range(n + 1, len(rt) + 1) IF rt[i].role = 'assistant'], ',') END AS rejected_mask
FROM r
"""

OP7 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, i AS pos, regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS ln,
         len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS w
  FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
c AS (
  SELECT *, (sum(w) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS c, (sum(w) OVER (PARTITION BY doc_id))::BIGINT AS total
  FROM l WHERE w > 0),
f AS (
  SELECT doc_id, pos AS s, max(pos) OVER a AS e, string_agg(ln, chr(10)) OVER a AS run FROM (SELECT *, c - w AS p FROM c)
  WINDOW a AS (PARTITION BY doc_id ORDER BY p RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) QUALIFY total - p >= 10),
b AS (
  SELECT doc_id, min(pos) OVER a AS s, pos AS e, string_agg(ln, chr(10)) OVER a AS run FROM c
  WINDOW a AS (PARTITION BY doc_id ORDER BY c RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) QUALIFY c >= 10),
w AS (SELECT * FROM f UNION SELECT * FROM b),
later AS (SELECT doc_id, s, e FROM (SELECT *, min((doc_id, s)) OVER (PARTITION BY run) AS first FROM w) WHERE (doc_id, s) > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM later),
g AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY 1)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(gone, i)], chr(10)) END AS text
FROM d LEFT JOIN g USING (doc_id)
"""

OP8 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(root, node) AS (SELECT i, i FROM l UNION SELECT r.root, l.j FROM reach r JOIN l ON l.i = r.node),
comp AS (SELECT node AS vec_id, min(root) AS c FROM reach GROUP BY 1),
n AS (SELECT i AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""

OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh
  FROM w),
t AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (
  SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 85 * (a.n + b.n - c)),
two AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
reach(root, node) AS (SELECT i, i FROM two UNION SELECT r.root, b.j FROM reach r JOIN two b ON b.i = r.node),
comp AS (SELECT node AS doc_id, min(root) AS c FROM reach GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c, n.doc_id) AS component_id FROM n LEFT JOIN comp USING (doc_id)
"""
