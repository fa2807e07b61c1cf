"""DuckDB SQL of the queries that SQL can express."""

ORACLE = {}

ORACLE["op6_poisson_mix"] = """
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, ''))) AS bytes FROM documents GROUP BY source
), rate AS (
  SELECT source, (SELECT sum(bytes) FROM sizes)
                 * (sqrt(bytes::DOUBLE) / (SELECT sum(sqrt(bytes::DOUBLE)) FROM sizes WHERE bytes > 0)) / bytes AS rate
  FROM sizes WHERE bytes > 0
), pmf AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rate, range(0, 80) t(k)
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM pmf
), drawn AS (
  SELECT *, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS own,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':1'), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS u
  FROM documents
), counted AS (
  SELECT d.*, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.below <= d.u) AS n
  FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       md5('17/order:' || own || ':' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted WHERE n > 0)
"""

ORACLE["op2_winnowing"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), gram AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT r, i, gram.n, item FROM gram JOIN win ON gram.n = win.n AND gram.gram = win.gram
), word AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN found USING (r)
"""

ORACLE["op7_warc_segments"] = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT page_id, payload, h, min(page_id) OVER (PARTITION BY h) AS first,
         list_transform(range(0, 8), lambda i: ('0x' || substr(h, (i * 5 + 1)::BIGINT, 5))::BIGINT) AS parts
  FROM page
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda v:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id != first THEN first END AS refers_to
FROM bits
"""

ORACLE["op9_suffix_dedup"] = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents
), part AS (
  SELECT r, doc_id, p, substr(h, 2 * p + 1, 2 * (256 + 49)) AS h
  FROM (SELECT r, doc_id, h, unnest(range(0, n - 49, 256)) AS p FROM doc WHERE n >= 50)
), string AS (
  SELECT r, doc_id, p + s AS s, substr(h, 2 * s + 1, 100) AS w
  FROM (SELECT r, doc_id, p, h, unnest(range(0, least(256, length(h) // 2 - 49))) AS s FROM part)
), least AS (
  SELECT w, min(doc_id) AS first FROM string GROUP BY w
), hit AS (
  SELECT r, s FROM string JOIN least USING (w) WHERE doc_id > first
), begun AS (
  SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM hit
), run AS (
  SELECT r, min(s) AS a, max(s) + 50 AS b
  FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS nr FROM begun) GROUP BY r, nr
), gap AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM run
), cut AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS upto,
         string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS before
  FROM gap JOIN doc USING (r) GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM doc LEFT JOIN cut USING (r)
"""
