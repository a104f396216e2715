"""DuckDB SQL of the catalogue's queries."""

OCC = """
occ AS (
  SELECT coalesce(lang, '?') AS package_id, printf('DOC-%06d', doc_id + 1) AS document_id, doc_id + 1 AS idx, sha256(text) AS sha,
         strlen(text) AS bytes, len(string_split(text, chr(10))) AS pages FROM documents),
dup AS (
  SELECT *, first_value(document_id) OVER (PARTITION BY package_id, sha ORDER BY idx) AS first_id,
         row_number() OVER (PARTITION BY package_id, sha ORDER BY idx) > 1 AS is_duplicate FROM occ)
"""
NORMAL = "replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
LINES = f"""
lines AS (
  SELECT coalesce(lang, '?') AS package_id, printf('DOC-%06d', doc_id + 1) AS document_id, doc_id, i - 1 AS page_index, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
pg AS (SELECT *, {NORMAL.format('line')} AS norm FROM lines),
fp AS (SELECT *, sha256(norm) AS text_hash, length(norm) <= 3 AS is_blank FROM pg)
"""
DOCS = f"""
{OCC}, {LINES},
uniq AS (SELECT package_id, document_id, idx FROM dup WHERE NOT is_duplicate),
df AS (
  SELECT fp.package_id, fp.document_id, any_value(idx) AS idx, count(*) FILTER (NOT is_blank) AS nb,
         string_agg(text_hash, '|' ORDER BY page_index) FILTER (NOT is_blank) AS sig
  FROM fp JOIN uniq USING (package_id, document_id) GROUP BY 1, 2),
bs AS (SELECT package_id, nb, count(*) AS n FROM df GROUP BY 1, 2 HAVING count(*) > 1)
"""
PACK = """
d AS (
  SELECT o_custkey::VARCHAR AS package_id, o_orderkey AS k, count(*) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY k) AS r FROM d),
walk AS (
  SELECT package_id, k, p, r, 1 AS part, p AS held, p > 12 AS closed FROM n WHERE r = 1
  UNION ALL
  SELECT n.package_id, n.k, n.p, n.r, w.part + (n.p > 12 OR w.closed OR w.held + n.p > 12)::INTEGER,
         CASE WHEN n.p > 12 OR w.closed OR w.held + n.p > 12 THEN n.p ELSE w.held + n.p END, n.p > 12
  FROM walk w JOIN n ON n.package_id = w.package_id AND n.r = w.r + 1)
"""
MERGED = """
l AS (
  SELECT coalesce(lang, '?') AS package_id, doc_id, i AS pos, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i) WHERE text IS NOT NULL),
b AS (
  SELECT package_id, 'D' || doc_id::VARCHAR AS document_id, doc_id, pos, line FROM l WHERE length(line) > 3
  UNION ALL SELECT package_id, 'M' || (doc_id // 10)::VARCHAR, doc_id, pos, line FROM l WHERE length(line) > 3),
pages AS (SELECT package_id, document_id, row_number() OVER (PARTITION BY package_id, document_id ORDER BY doc_id, pos) - 1 AS ord, line FROM b),
docs AS (SELECT package_id, document_id, count(*) AS n FROM pages GROUP BY 1, 2)
"""
MARKED = """
texts AS (SELECT ['closing disclosure page 1 of 5 loan terms projected payments', 'page 2 of 5 loan costs', 'closing disclosure page 3 of 5 cash to close',
  'loan estimate page 1 of 3 save this loan estimate to compare with your closing disclosure', 'loan estimate page 2 of 3 closing cost details comparisons',
  'alta settlement statement seller american land title association financial loan charges to', 'notice of denial', 'we are unable to proceed with your loan', 'ordinary page'] AS t),
p AS (
  SELECT printf('DOC-%06d', doc_id) AS document_id, i AS page_index, t[(doc_id * 7 + i * i * 5) % 9 + 1] AS t,
         try_cast(regexp_extract(t[(doc_id * 7 + i * i * 5) % 9 + 1], 'page\\s+\\d+\\s+of\\s+(\\d+)', 1) AS INTEGER) AS total
  FROM documents, texts, range(6) AS u(i)),
hit AS (
  SELECT 'closing_disclosure' AS category, * FROM p WHERE contains(t, 'closing disclosure') AND coalesce(total, 0) <> 3 AND NOT contains(t, 'compare with your closing disclosure')
  UNION ALL SELECT 'loan_estimate', * FROM p WHERE contains(t, 'loan estimate') AND coalesce(total, 0) <> 5
  UNION ALL SELECT 'alta_settlement_statement', * FROM p WHERE contains(t, 'alta settlement statement')),
g AS (SELECT *, CASE WHEN page_index - lag(page_index) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY category, document_id ORDER BY page_index)),
r AS (
  SELECT category, document_id, min(page_index) AS s, max(page_index) AS e
  FROM (SELECT *, sum(new) OVER (PARTITION BY category, document_id ORDER BY page_index) AS run FROM g) GROUP BY category, document_id, run),
m AS (
  SELECT category, document_id, s, e, coalesce(bool_or(total = 5), false) AS five, coalesce(bool_or(total = 3), false) AS three, bool_or(contains(t, 'american land title association')) AS byline,
         bool_or(contains(t, 'loan terms'))::INT + bool_or(contains(t, 'projected payments'))::INT + bool_or(contains(t, 'loan costs'))::INT + bool_or(contains(t, 'cash to close'))::INT AS cd,
         bool_or(contains(t, 'loan terms'))::INT + bool_or(contains(t, 'projected payments'))::INT + bool_or(contains(t, 'closing cost details'))::INT + bool_or(contains(t, 'comparisons'))::INT AS le,
         bool_or(contains(t, 'loan charges to'))::INT + bool_or(contains(t, 'financial'))::INT AS al, bool_or(contains(t, 'seller')) AS seller
  FROM r JOIN p USING (document_id) WHERE page_index BETWEEN s AND e GROUP BY ALL),
k AS (
  SELECT document_id, category, CASE WHEN category = 'alta_settlement_statement' AND seller THEN 'Seller' END AS subtype,
         CASE category WHEN 'closing_disclosure' THEN CASE WHEN five AND cd >= 2 THEN 'Confirmed' WHEN five THEN 'Strong Match' ELSE 'Possible Match' END
           WHEN 'loan_estimate' THEN CASE WHEN three AND le >= 2 THEN 'Confirmed' WHEN three THEN 'Strong Match' ELSE 'Possible Match' END
           ELSE CASE WHEN byline AND al >= 2 THEN 'Confirmed' WHEN byline OR al >= 2 THEN 'Strong Match' ELSE 'Possible Match' END END AS confidence_band,
         s + 1 AS first_page, e + 1 AS last_page, CASE WHEN category = 'closing_disclosure' THEN 'Unsigned' END AS signature_status
  FROM m
  UNION ALL SELECT document_id, 'non_proceeding', 'Denial Notice', 'Confirmed', page_index + 1, page_index + 1, NULL FROM p WHERE contains(t, 'notice of denial')
  UNION ALL SELECT document_id, 'non_proceeding', 'Other Non-Proceeding Document', 'Possible Match', page_index + 1, page_index + 1, NULL FROM p WHERE contains(t, 'unable to proceed with your loan'))
"""

SQL = {
    "exact_dup_groups": """
WITH o AS (SELECT coalesce(lang, '?') AS package_id, doc_id, sha256(text) AS sha FROM documents)
SELECT package_id, sha, min(doc_id) AS retained_doc_id, count(*) AS n_members, count(*) - 1 AS n_redundant
FROM o GROUP BY package_id, sha HAVING count(*) > 1""",
    "exact_dup_flags": f"WITH {OCC} SELECT package_id, document_id, is_duplicate, CASE WHEN is_duplicate THEN first_id END AS duplicate_of FROM dup",
    "og_final_reconcile": f"""WITH {OCC} SELECT package_id, count(*) AS in_original, count(*) FILTER (is_duplicate) AS exact_duplicates,
count(*) FILTER (NOT is_duplicate) AS in_final, sum(bytes)::BIGINT AS bytes FROM dup GROUP BY 1""",
    "page_explode": f"WITH {LINES} SELECT package_id, document_id, page_index::INTEGER AS page_index, length(line)::INTEGER AS n_chars FROM lines",
    "page_normalize_hash": f"WITH {LINES} SELECT package_id, document_id, page_index::INTEGER AS page_index, text_hash FROM fp",
    "struct_tokens": r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) || printf(' due 2026-01-%02d or 1/%d/26 for $%d.50', doc_id % 28 + 1, doc_id % 28 + 1, doc_id) AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b', 1))), '|') AS dates,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\$\s?[\d,]+(?:\.\d{2})?'))), '|') AS dollars,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?:$|[^\p{L}\p{N}_])', 1))), '|') AS names FROM t""",
    "blank_pages": f"WITH {LINES} SELECT package_id, count(*) FILTER (is_blank) AS blank, count(*) AS pages FROM fp GROUP BY 1",
    "doc_fingerprint": f"""WITH {LINES} SELECT package_id, document_id, sha256(string_agg(text_hash, '|' ORDER BY page_index)) AS document_hash, count(*)::INTEGER AS page_count,
count(*) FILTER (NOT is_blank)::INTEGER AS non_blank_pages, sum(length(norm))::BIGINT AS text_length FROM fp GROUP BY 1, 2""",
    "wrap_lines": """
WITH l AS (SELECT doc_id, i AS line_at, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
w AS (SELECT doc_id, line_at, j, CASE WHEN line = '' THEN ' ' ELSE substr(line, j * 100 + 1, 100) END AS line FROM l, unnest(range(0, greatest(1, (length(line) + 99) // 100))) AS u(j))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_at, j) - 1)::INTEGER AS line_no, line FROM w""",
    "paragraph_chunks": r"""
WITH t AS (SELECT doc_id, regexp_split_to_array(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n(?:[ \t]*\n)+') AS b FROM documents),
c AS (SELECT doc_id, i, array_to_string([trim(x) FOR x IN string_split(b[i], chr(10)) IF trim(x) <> ''], ' ') AS chunk FROM t, unnest(range(1, len(b) + 1)) AS u(i))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_no, chunk FROM c WHERE chunk <> ''""",
    "garbled_text": r"""
WITH t AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 7 = 0 THEN regexp_replace(text, '\s', '', 'g') ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, length(t) >= 200 AND (length(t) - length(regexp_replace(t, '\s', '', 'g')))::DOUBLE / greatest(length(t), 1) < 0.03 AS garbled FROM t""",
    "disguised_binary": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(CASE WHEN doc_id % 4 = 3 THEN text ELSE base64(encode(CASE doc_id % 4 WHEN 0 THEN '%PDF-' WHEN 1 THEN 'PK' || chr(3) || chr(4) ELSE '' END || text)) END, '\s+', '', 'g') AS t FROM documents),
h AS (SELECT doc_id, CASE WHEN length(t) >= 200 AND length(t) % 4 = 0 AND regexp_full_match(t, '[A-Za-z0-9+/]+={0,2}') THEN hex(from_base64(left(t, 24))) END AS h FROM t)
SELECT doc_id, CASE WHEN h LIKE '255044462D%' THEN 'PDF' WHEN h LIKE '504B0304%' THEN 'ZIP' WHEN h LIKE 'D0CF11E0A1B11AE1%' THEN 'OLE' WHEN h LIKE 'FFD8FF%' THEN 'JPEG' WHEN h LIKE '89504E470D0A1A0A%' THEN 'PNG' END AS kind FROM h""",
    "page_totals": "SELECT doc_id, (doc_id % 11)::INTEGER AS total FROM documents",
    "safe_paths": r"""
WITH u AS (SELECT page_id, replace(CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?:/', '') WHEN 1 THEN regexp_replace(url, '^https?://', '../') WHEN 2 THEN regexp_replace(url, '^https?://', 'a\\./b//') ELSE url END, '\', '/') AS p FROM pages),
k AS (SELECT page_id, p, [x FOR x IN string_split(p, '/') IF x NOT IN ('', '.')] AS k FROM u)
SELECT page_id, CASE WHEN p LIKE '/%' OR substr(p, 2, 1) = ':' OR list_contains(k, '..') OR len(k) = 0 THEN 'BLOCKED_UNSAFE_PATH/' || coalesce(k[-1], 'unnamed_entry') ELSE array_to_string(k, '/') END AS path FROM k""",
    "ignored_artifacts": "SELECT page_id, page_id % 5 IN (0, 1, 2) AS ignored FROM pages",
    "sanitized_names": r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(' .' || p_name || '<>:"  |?*' || p_type || '. ', '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS name FROM part""",
    "natural_order": r"""SELECT p_partkey, p_brand || ' File' || p_partkey AS name, row_number() OVER (ORDER BY regexp_replace(p_brand, '\d+', ''), regexp_extract(p_brand, '(\d+)', 1)::BIGINT, p_partkey)::INTEGER AS place FROM part""",
    "folder_identity": r"""
WITH f AS (SELECT c_custkey, trim(CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ', ' || c_name || ', ' || c_custkey WHEN 1 THEN c_mktsegment || ' ,' || c_name ELSE c_name END) AS f FROM customer)
SELECT c_custkey, CASE WHEN contains(f, ',') THEN trim(string_split(f, ',')[1]) ELSE f END AS last_name, coalesce(trim(string_split(f, ',')[2]), '') AS first_name, coalesce(trim(string_split(f, ',')[3]), '') AS loan_number FROM f""",
    "part_filename": """
SELECT c_custkey, c_mktsegment || ', ' || c_name || ', Lender Package' || CASE WHEN c_custkey % 2 = 0 THEN ', Lender A' ELSE '' END || ', ' || c_custkey
  || CASE WHEN c_custkey % 3 > 0 THEN printf(', Part %03d', c_custkey % 3 + 1) ELSE '' END || '.pdf' AS filename FROM customer""",
    "collision_suffix": """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey, p_type || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.pdf' AS filename FROM n""",
    "plan_parts": f"WITH RECURSIVE {PACK} SELECT package_id, k::VARCHAR AS document_id, part, p AS pages FROM walk",
    "close_reasons": f"""
WITH RECURSIVE {PACK},
q AS (SELECT package_id, part, sum(p)::BIGINT AS page_count, count(*) AS n_documents, arg_min(p, r) AS first_p FROM walk GROUP BY 1, 2),
z AS (SELECT *, lead(first_p) OVER (PARTITION BY package_id ORDER BY part) AS next_p, n_documents = 1 AND page_count > 12 AS is_oversized FROM q),
c AS (SELECT *, array_to_string([x FOR x IN [CASE WHEN is_oversized THEN 'oversized_document' END, CASE WHEN next_p IS NULL THEN 'end_of_package' END, CASE WHEN page_count + next_p > 12 THEN 'page_maximum' END] IF x IS NOT NULL], '|') AS r FROM z)
SELECT package_id, part, page_count, n_documents, is_oversized, CASE WHEN r = '' THEN 'end_of_package' ELSE r END AS close_reasons FROM c""",
    "part_offsets": f"""WITH RECURSIVE {PACK} SELECT package_id, k::VARCHAR AS document_id, part,
coalesce(sum(p) OVER (PARTITION BY package_id, part ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_in_part,
coalesce(sum(p) OVER (PARTITION BY package_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_overall FROM walk""",
    "oversized_parts": f"WITH RECURSIVE {PACK} SELECT package_id, count(*) AS n, max(p) AS largest FROM walk WHERE p > 12 GROUP BY 1",
    "package_rollup": f"WITH {OCC} SELECT package_id, short, count(*) AS documents, sum(pages)::BIGINT AS pages FROM (SELECT *, pages BETWEEN 1 AND 5 AS short FROM occ) GROUP BY ROLLUP (package_id, short)",
    "bucket_stats": f"WITH {DOCS} SELECT package_id, count(*) AS buckets, max(n) AS largest, sum(n * (n - 1) // 2)::BIGINT AS pairs, count(*) FILTER (n > 50) AS capped FROM bs GROUP BY 1",
    "candidate_pairs": f"""WITH {DOCS} SELECT a.package_id, a.document_id AS a_id, b.document_id AS b_id FROM df a JOIN df b ON a.package_id = b.package_id AND a.nb = b.nb AND a.idx < b.idx
JOIN bs ON bs.package_id = a.package_id AND bs.nb = a.nb WHERE bs.n <= 50""",
    "hash_only_groups": f"""WITH {DOCS}, s AS (SELECT df.*, first_value(document_id) OVER (PARTITION BY df.package_id, df.nb, sig ORDER BY idx) AS a_id FROM df JOIN bs USING (package_id, nb) WHERE bs.n > 50)
SELECT package_id, a_id, document_id AS b_id FROM s WHERE document_id <> a_id""",
    "canonical_pick": f"""
WITH {LINES}, d AS (SELECT package_id, document_id, any_value(doc_id) AS i, sha256(string_agg(text_hash, '|' ORDER BY page_index)) AS document_hash, count(*) FILTER (is_blank) AS blanks, sum(length(norm)) AS n FROM fp GROUP BY 1, 2)
SELECT package_id, document_hash, arg_min(document_id, (blanks, -n, i)) AS canonical_id, count(*) AS members FROM d GROUP BY 1, 2 HAVING count(*) > 1""",
    "exact_containment": f"""
WITH {MERGED},
f AS (SELECT p.package_id, p.document_id, p.line, n AS need FROM pages p JOIN docs USING (package_id, document_id) WHERE ord = 0),
s AS (
  SELECT f.package_id, f.document_id, c.document_id AS container_id, c.ord AS start, need FROM f JOIN pages c ON c.package_id = f.package_id AND c.line = f.line
  JOIN docs d ON d.package_id = c.package_id AND d.document_id = c.document_id WHERE d.n > need AND c.ord + need <= d.n),
h AS (
  SELECT s.package_id, s.document_id, s.container_id, s.start, need FROM s JOIN pages a ON a.package_id = s.package_id AND a.document_id = s.document_id
  JOIN pages b ON b.package_id = s.package_id AND b.document_id = s.container_id AND b.ord = s.start + a.ord AND b.line = a.line GROUP BY ALL HAVING count(*) = need)
SELECT package_id, document_id, container_id, min(start) AS start, min(start) + any_value(need) - 1 AS "end" FROM h GROUP BY 1, 2, 3""",
    "partial_overlap": f"""
WITH {MERGED},
m AS (
  SELECT a.package_id, a.document_id, b.document_id AS container_id, a.ord AS i, b.ord - a.ord AS diagonal, x.n FROM pages a JOIN pages b ON a.package_id = b.package_id AND a.line = b.line AND a.document_id <> b.document_id
  JOIN docs x ON x.package_id = a.package_id AND x.document_id = a.document_id JOIN docs y ON y.package_id = b.package_id AND y.document_id = b.document_id WHERE y.n > x.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY package_id, document_id, container_id, diagonal ORDER BY i) AS isle FROM m),
r AS (SELECT package_id, document_id, container_id, n, count(*) AS run FROM g GROUP BY package_id, document_id, container_id, n, diagonal, isle)
SELECT package_id, document_id, container_id, max(run) AS run, round(max(run) / n, 6) AS share FROM r GROUP BY package_id, document_id, container_id, n HAVING max(run) / n >= 0.4""",
    "components": """
WITH RECURSIVE l AS (SELECT DISTINCT coalesce(lang, '?') AS package_id, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
e AS (SELECT DISTINCT package_id, doc_id AS a, min(doc_id) OVER (PARTITION BY package_id, line) AS b FROM l WHERE length(line) > 3),
x AS (SELECT package_id, a, b FROM e WHERE a <> b UNION SELECT package_id, b, a FROM e WHERE a <> b),
reach(package_id, root, node) AS (SELECT package_id, a, a FROM x UNION SELECT r.package_id, r.root, x.b FROM reach r JOIN x ON x.package_id = r.package_id AND x.a = r.node)
SELECT package_id, node AS id, min(root) AS component FROM reach GROUP BY 1, 2""",
    "key_doc_ranges": f"WITH {MARKED} SELECT document_id, category, subtype, confidence_band, first_page::INTEGER AS first_page, last_page::INTEGER AS last_page, signature_status FROM k",
    "key_doc_counts": f"""WITH {MARKED} SELECT category, confidence_band, count(*) AS n, sum(CASE confidence_band WHEN 'Confirmed' THEN 100 WHEN 'Strong Match' THEN 75 ELSE 40 END)::BIGINT AS points FROM k GROUP BY 1, 2""",
    "gaps_islands": f"""
WITH {LINES}, g AS (SELECT doc_id, page_index, CASE WHEN page_index - lag(page_index) OVER (PARTITION BY doc_id ORDER BY page_index) <= 2 THEN 0 ELSE 1 END AS new FROM lines WHERE contains(line, 'tion')),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page_index) AS run FROM g)
SELECT doc_id, min(page_index)::INTEGER AS start, max(page_index)::INTEGER AS "end" FROM r GROUP BY doc_id, run""",
    "duplicate_log": f"WITH {OCC} SELECT package_id, 'exact' AS method, first_id AS retained_id, document_id FROM dup WHERE is_duplicate",
    "processing_report": f"""
WITH {OCC}, {LINES},
n AS (SELECT package_id, count(*) AS pages, count(*) FILTER (is_blank) AS blank_pages, count(DISTINCT text_hash) AS distinct_pages FROM fp GROUP BY 1)
SELECT package_id, count(*) AS found, 0::BIGINT AS ignored, count(*) FILTER (is_duplicate) AS exact_duplicates, 0::BIGINT AS content_duplicates, 0::BIGINT AS contained, 0::BIGINT AS needs_review, 0::BIGINT AS placeholders,
  count(*) FILTER (NOT is_duplicate) AS in_final, count(DISTINCT sha) AS distinct_hashes, any_value(n.pages) AS pages, any_value(blank_pages) AS blank_pages, any_value(distinct_pages) AS distinct_pages
FROM dup JOIN n USING (package_id) GROUP BY 1""",
    "final_parts": f"""
WITH RECURSIVE {OCC},
n AS (SELECT package_id, document_id, idx, pages AS p, bytes AS b, row_number() OVER (PARTITION BY package_id ORDER BY idx) AS r FROM dup WHERE NOT is_duplicate),
walk AS (
  SELECT package_id, document_id, p, r, 1 AS part, p AS held, b AS size, p > 100 OR b > 104857600 AS closed FROM n WHERE r = 1
  UNION ALL
  SELECT n.package_id, n.document_id, n.p, n.r, w.part + (n.p > 100 OR n.b > 104857600 OR w.closed OR w.held + n.p > 100 OR w.size + n.b > 104857600)::INTEGER,
         CASE WHEN n.p > 100 OR n.b > 104857600 OR w.closed OR w.held + n.p > 100 OR w.size + n.b > 104857600 THEN n.p ELSE w.held + n.p END,
         CASE WHEN n.p > 100 OR n.b > 104857600 OR w.closed OR w.held + n.p > 100 OR w.size + n.b > 104857600 THEN n.b ELSE w.size + n.b END, n.p > 100 OR n.b > 104857600
  FROM walk w JOIN n ON n.package_id = w.package_id AND n.r = w.r + 1)
SELECT package_id, part, sum(p)::BIGINT AS page_count, count(*) AS n_documents, string_agg(document_id, '|' ORDER BY r) AS documents FROM walk GROUP BY 1, 2""",
    "exact_normalized": f"SELECT doc_id, sha256({NORMAL.format('text')}) AS sha FROM documents",
    "difference_hashes": """
SELECT vec_id, list_sum([CASE WHEN embedding[i] < embedding[i + 1] THEN 1::HUGEINT << (63 - i) ELSE 0 END FOR i IN range(1, 64)])::BIGINT AS dhash FROM embeddings""",
    "difference_hash_grid": """
SELECT vec_id, list_sum([CASE WHEN embedding[(i // 7) * 8 + i % 7 + 1] < embedding[(i // 7) * 8 + i % 7 + 2] THEN 1::HUGEINT << (55 - i) ELSE 0 END FOR i IN range(0, 56)])::BIGINT AS dhash FROM embeddings""",
    "blank_images": """
WITH p AS (SELECT vec_id, [greatest(CASE WHEN label < 4 THEN 254 ELSE 0 END, least(255, floor(abs(x::DOUBLE) * 1000)))::DOUBLE FOR x IN embedding] AS p FROM embeddings),
m AS (SELECT vec_id, list_sum(p) / len(p) AS mean, list_sum([x * x FOR x IN p]) / len(p) AS square, len([x FOR x IN p IF x < 220])::DOUBLE / len(p) AS ink FROM p)
SELECT vec_id, ink <= 0.0008 AND square - mean * mean <= 40.0 AS is_blank FROM m""",
    "shortened_paths": r"""
WITH p AS (SELECT doc_id, replace(text, chr(10), '/') || '.pdf' AS p FROM documents)
SELECT doc_id, CASE WHEN length(p) <= 200 THEN p ELSE rtrim(left(left(p, length(p) - 4), 196), ' ') || '.pdf' END AS path FROM p""",
    "admitted_entries": f"""
WITH {OCC} SELECT package_id, document_id,
  count(*) OVER w <= 150 AND coalesce(sum(bytes) OVER w, 0) <= 300000 AS admitted
FROM occ WINDOW w AS (PARTITION BY package_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
    "hamming_distances": """
WITH h AS (SELECT vec_id, label, list_sum([CASE WHEN embedding[i] < embedding[i + 1] THEN 1::HUGEINT << (63 - i) ELSE 0 END FOR i IN range(1, 64)])::BIGINT AS h FROM embeddings),
n AS (SELECT *, lead(h) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM h)
SELECT vec_id, bit_count(xor(h, n))::BIGINT AS distance FROM n WHERE n IS NOT NULL""",
    "color_distances": """
WITH c AS (SELECT vec_id, [abs(round(x::DOUBLE * 255)) FOR x IN embedding[1:6]] AS c FROM embeddings)
SELECT vec_id, round(1.0 - sqrt(pow(c[1] - c[4], 2) + pow(c[2] - c[5], 2) + pow(c[3] - c[6], 2)) / sqrt(3 * 255.0 * 255.0), 9) AS similarity FROM c""",
}

CLOSED = "CASE x WHEN 'page_maximum' THEN 'the next document would exceed the page maximum' WHEN 'oversized_document' THEN 'one document is larger than a part may be' ELSE 'end of the package' END"
SQL |= {
    "part_lines": f"""
SELECT package_id, part, printf('%d documents, %d pages, 0 bytes', n_documents, page_count) || CASE WHEN is_oversized THEN ' (one oversized document)' ELSE '' END || ': ' ||
  array_to_string([{CLOSED} FOR x IN string_split(close_reasons, '|')], '; ') AS line FROM ({SQL['close_reasons']})""",
    "extracted_pages": f"""
SELECT document_id, category, g AS page_index FROM (SELECT *, unnest(range(first_page - 1, last_page)) AS g FROM ({SQL['key_doc_ranges']}) WHERE confidence_band IN ('Confirmed', 'Strong Match'))""",
    "source_hashes": """
WITH f AS (
  SELECT coalesce(lang, '?') || '-' || (doc_id // 40)::VARCHAR AS package_id, doc_id, hex(doc_id::VARCHAR || '.txt') || hex(strlen(text)::VARCHAR) || upper(sha256(text)) AS h FROM documents WHERE text IS NOT NULL)
SELECT package_id, sha256(unhex(coalesce(string_agg(h, '' ORDER BY doc_id) FILTER (doc_id % 2 = 0), '') || hex('|side|') || coalesce(string_agg(h, '' ORDER BY doc_id) FILTER (doc_id % 2 = 1), '') || hex('|side|'))) AS hash
FROM f GROUP BY 1""",
    "output_folders": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ', ' || c_name ELSE c_name || '_Lender_Package_Output_20260102_030405' END AS folder FROM customer",
    "unconverted_targets": """
WITH p AS (SELECT (page_id // 40)::VARCHAR AS package_id, printf('DOC-%06d', page_id) AS document_id, page_id % 5 AS k, row_number() OVER (PARTITION BY page_id // 40, page_id % 5 ORDER BY page_id) AS nth FROM pages)
SELECT package_id, document_id, 'in/' || k::VARCHAR || CASE WHEN nth > 1 THEN '_' || document_id ELSE '' END || '.eml' AS target FROM p""",
    "bundled_names": """
WITH p AS (SELECT (p_partkey // 40)::VARCHAR AS package_id, p_partkey::INTEGER AS "at", string_split(p_type, ' ')[1] AS n FROM part),
q AS (SELECT *, row_number() OVER (PARTITION BY package_id, n ORDER BY "at") AS k FROM p)
SELECT package_id, "at", n || '.txt' AS name, n || CASE WHEN k > 1 THEN ' (' || k::VARCHAR || ')' ELSE '' END || '.txt' AS target FROM q""",
    "history_entries": """
SELECT coalesce(lang, '') AS last_name, coalesce(source, '') AS first_name, doc_id::VARCHAR AS loan_number, doc_id % 2 = 0 AS is_adverse, coalesce(n_chars, 0)::BIGINT AS document_count, '' AS status
FROM documents WHERE doc_id % 3 <> 0""",
}
