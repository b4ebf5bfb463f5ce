"""SQL of the operators whose results are exact: direct statements of what they compute, without their methods."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = "translate(coalesce(text, ''), '{}', '{}')".format(UPPER, LOWER)
_PLAIN_WORDS = r"[^\x20\x09-\x0D]+"

#: Windows of ten item words (whole shorter items) looked up at every place of every document.
DECONTAMINATION = rf"""
WITH iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM d, (SELECT DISTINCT size FROM win) s, unnest(range(1, len(w) - size + 2)) u(i)
), hits AS (
  SELECT r, i, p.size, item FROM places p JOIN win ON p.size = win.size AND p.words = win.words
), words AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT r, i, size FROM hits), unnest(range(i, i + size)) u(pos) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

#: Every window of twenty words against its first place in the order of (document, start).
SUBSTRING_DEDUP = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN_WORDS}') AS w FROM documents
), places AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words FROM d, unnest(range(1, len(w) - 18)) u(i)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS n FROM places) WHERE n > 1
), gone AS (
  SELECT doc_id, list(DISTINCT pos) AS gone FROM later, unnest(range(i, i + 20)) u(pos) GROUP BY doc_id
), marked AS (
  SELECT doc_id, pos, word, list_contains(gone, pos) AS cut FROM (
    SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d JOIN gone USING (doc_id)) JOIN gone USING (doc_id)
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE cut) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT cut), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, array_to_string(w, ' '))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: All pairs of documents that share a shingle, and what can be reached over similar ones.
NGRAM_JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '{_PLAIN_WORDS}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM link UNION SELECT y, x FROM link
), reach(x, y) AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), low AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.x = d.doc_id
"""
