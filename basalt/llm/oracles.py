"""SQL (DuckDB) that gives the rows of those queries that SQL can express."""

from __future__ import annotations

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     b AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d),
     w AS (SELECT doc_id, p, CASE WHEN 2 * p + 200 <= length(h) THEN md5(substring(h, 2 * p + 1, 200)) END AS s, substring(h, 2 * p + 1, 2) AS x FROM b),
     f AS (SELECT *, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM w),
     g AS (SELECT *, coalesce(p - max(CASE WHEN again THEN p END) OVER (PARTITION BY doc_id ORDER BY p) < 100, FALSE) AS gone FROM f),
     e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS edge FROM g)
SELECT doc_id, CAST(count(p) AS BIGINT) AS n_bytes, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       CAST(count(*) FILTER (WHERE edge) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone), ''))) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id) GROUP BY doc_id
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
     s AS (SELECT doc_id, p, w[p] AS x, CASE WHEN p + 12 <= len(w) THEN array_to_string(w[p : p + 12], ' ') END AS t FROM o),
     f AS (SELECT *, t IS NOT NULL AND min(doc_id) OVER (PARTITION BY t) < doc_id AS again FROM s),
     g AS (SELECT *, coalesce(p - max(CASE WHEN again THEN p END) OVER (PARTITION BY doc_id ORDER BY p) < 13, FALSE) AS gone FROM f)
SELECT doc_id, CAST(count(p) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) GROUP BY doc_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE
     d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS t
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common * 10 >= 8 * (x.n + y.n - common)
               UNION SELECT p.doc_id, q.doc_id FROM d p JOIN d q ON p.text = q.text AND p.doc_id <> q.doc_id),
     reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
     c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a)
SELECT d.doc_id, class_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links,
       count(*) OVER (PARTITION BY d.text) AS n_copies
FROM d JOIN c ON c.a = d.doc_id
"""
