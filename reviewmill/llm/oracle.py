"""DuckDB SQL for the queries that SQL can express on whole tables."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH thin AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM thin GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM sizes),
weighted AS (
  SELECT *, CAST(source_no % 3 + 1 AS DOUBLE) AS w, 3 * source_size AS cap FROM numbered),
total AS (SELECT CAST(coalesce(sum(source_size), 0) AS BIGINT) AS budget FROM sizes),
ordered AS (
  SELECT cap, w, coalesce(sum(cap) OVER (ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY cap / w, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         row_number() OVER (ORDER BY cap / w, source_no) AS place
  FROM weighted),
levels AS (SELECT place, (budget - full_before) / open_w AS level, cap / w AS own FROM ordered, total),
water AS (SELECT arg_min(level, place) AS level FROM levels WHERE level <= own),
placed AS (
  SELECT t.*, s.source_no, s.source_size, s.w, least(s.w * water.level, CAST(s.cap AS DOUBLE)) AS target,
         CAST(sum(size) OVER (PARTITION BY s.source_no ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM thin t JOIN weighted s ON t.source IS NOT DISTINCT FROM s.source, water),
offers AS (
  SELECT (turn * source_size + cum) / w AS finish, source_no, size
  FROM placed, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0),
run AS (
  SELECT finish, source_no, sum(size) OVER (ORDER BY finish, source_no ROWS UNBOUNDED PRECEDING) AS total FROM offers),
cut AS (
  SELECT finish, source_no FROM run, total WHERE run.total <= budget ORDER BY finish DESC, source_no DESC LIMIT 1),
taken AS (
  SELECT doc_id, p.source_no, size, source_size, target,
         list_sum([CAST(((turn * source_size + cum) / w, p.source_no) <= (c.finish, c.source_no) AS BIGINT)
                   FOR turn IN [0, 1, 2]]) AS times
  FROM placed p, cut c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * times AS BIGINT) AS taken
FROM taken
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(%s, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(%s, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dwin.n, item_id FROM dwin JOIN win USING (win)),
spots AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
""" % (LOWER.format("text"), LOWER.format("text"))

OP8 = r"""
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, %s AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
urls AS (SELECT DISTINCT host, path FROM split),
best AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY host, path
                            ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS r
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (host, path)
""" % LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")

OP5 = """
WITH d AS (SELECT doc_id, sha256(%s) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
""" % LOWER.format("coalesce(text, '')")

OP4 = r"""
WITH lines AS (
  SELECT doc_id, line, generate_subscripts AS nr, %s AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS generate_subscripts
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, nr, line, last IS NOT NULL AND last <> doc_id AS gone FROM lines LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""" % LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
strings AS (
  SELECT r, s, md5_number(array_slice(b, s, s + 399)) AS h
  FROM (SELECT r, b, unnest(generate_series(1, octet_length(b) - 399)) AS s FROM d)),
repeated AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
marks AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM strings JOIN repeated USING (h)),
runs AS (SELECT r, s, count(*) FILTER (before IS NULL OR s > before + 400) OVER (PARTITION BY r ORDER BY s) AS run FROM marks),
spans AS (SELECT r, run, min(s) AS a, max(s) + 399 AS z FROM runs GROUP BY r, run),
edges AS (
  SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS from_, a - 1 AS to_, z - a + 1 AS n FROM spans
  UNION ALL
  SELECT r, octet_length(b) + 1, coalesce(max(z), 0) + 1, octet_length(b), 0 FROM d LEFT JOIN spans USING (r) GROUP BY r, b)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(sum(n) AS BIGINT) AS n_removed, count(*) FILTER (n > 0) AS n_spans,
       sha256(unhex(string_agg(CASE WHEN to_ < from_ THEN '' ELSE hex(array_slice(b, from_, to_)) END, '' ORDER BY a))) AS kept_sha256
FROM d JOIN edges USING (r) GROUP BY r, doc_id, b
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLE = {"op1_mixing": OP1, "op4_line_dedup": OP4, "op5_exact_dedup": OP5, "op7_decontamination": OP7,
          "op8_url_filter": OP8, "op11_substring_dedup": OP11,
          "op12_hard_negatives": OP12}
