"""SQL for results of this package that SQL can express."""

from __future__ import annotations

#: In hexadecimal, so that positions are bytes; long texts are first cut in pieces that overlap by a window.
REPEATED_STRINGS = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), pieces AS (
  SELECT rid, doc_id, n, pos, substr(h, 2 * pos + 1, 2 * (400 + 49)) AS piece FROM (SELECT *, unnest(generate_series(0, n - 50, 400)) AS pos FROM d WHERE n >= 50)
), windows AS (
  SELECT rid, doc_id, pos + k AS pos, substr(piece, 2 * k + 1, 100) AS s FROM (SELECT *, unnest(generate_series(0, least(399, n - 50 - pos))) AS k FROM pieces)
), shared AS (
  SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s HAVING count(*) > 1
), hits AS (
  SELECT rid, pos, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS before FROM windows JOIN shared USING (s) WHERE first_doc < doc_id
), numbered AS (
  SELECT rid, pos, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS run FROM hits
), runs AS (
  SELECT rid, run, min(pos) AS a, max(pos) + 50 AS b FROM numbered GROUP BY rid, run
), gaps AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS from_at FROM runs
), left_over AS (
  SELECT d.rid, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * from_at + 1, 2 * (a - from_at)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM d JOIN gaps ON d.rid = gaps.rid GROUP BY d.rid
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN left_over ON d.rid = left_over.rid
"""

#: CRCs of the different features from a table of what a byte adds at each distance from the end.
IMPORTANCE_DRAW = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, 0 AS side FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 1 FROM benchmark
), listed AS (
  SELECT rid, doc_id, side, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS MATERIALIZED (
  SELECT rid, side, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM listed
), kinds AS (
  SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS n FROM (SELECT DISTINCT f FROM features)
), steps(byte, k, r) AS (
  SELECT b, -8, b FROM range(257) AS x(b)
  UNION ALL SELECT byte, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END
    FROM (SELECT byte, k, CASE WHEN byte = 256 AND k = -8 THEN 4294967295 ELSE r END AS r FROM steps) WHERE k < 8 * (SELECT max(n) FROM kinds)
), adds AS (
  SELECT byte, k // 8 AS far, r FROM steps WHERE k >= 0 AND k % 8 = 0
), codes AS (
  SELECT f, any_value(n) AS n, bit_xor(adds.r) AS r FROM (SELECT f, n, h, unnest(range(n)) AS k FROM kinds) b JOIN adds ON byte = CAST('0x' || substr(h, 2 * k + 1, 2) AS INT) AND far = n - 1 - k GROUP BY f
), buckets AS MATERIALIZED (
  SELECT f, xor(xor(codes.r, last.r), 4294967295) % 10000 AS bucket FROM codes JOIN adds last ON last.byte = 256 AND last.far = n - 1
), used AS MATERIALIZED (
  SELECT rid, side, bucket FROM features JOIN buckets USING (f)
), counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM used GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counts
), weights AS (
  SELECT rid, count(*) AS n, sum(gain) AS total FROM used JOIN gains USING (bucket) WHERE side = 0 GROUP BY rid
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM listed LEFT JOIN weights USING (rid) WHERE side = 0
), noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS eligible FROM noisy
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank
FROM placed
"""

SOURCE_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), used AS MATERIALIZED (
  SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), totals AS (
  SELECT lang, term, count(*) AS n FROM used GROUP BY lang, term HAVING count(DISTINCT rid) >= 10
), counts AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM used SEMI JOIN totals USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(whole, 0) AS whole FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS whole FROM totals GROUP BY ALL) USING (lang)
), shares AS MATERIALIZED (
  SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (s.n + 2 * v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (t.n + 2) // (whole + 2 * v) AS BIGINT) AS q
  FROM sizes s JOIN totals t USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank FROM placed WHERE part = 'pair' OR place <= 10
"""
