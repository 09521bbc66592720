"""SQL for the queries that SQL can express; the other operators are tested against plain versions."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
g AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)-3)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, range(5) AS r(k) GROUP BY 1),
f AS (SELECT w.doc_id, t, len(w)::bigint AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint AS n_symbols,
  (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * len(string_split(t, chr(10))) OR word_chars > 25 * n_words OR word_chars < n_words
    OR 2 * length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) > length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) OR 5 * (length(t) - length(translate(t, '!', ''))) > n_words) AS kept
FROM b
"""

REVISITS = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT *, strlen(h)::bigint AS n, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS r FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN r = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> page_id THEN r END AS refers_to FROM b
"""

REPEATS = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i+12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)-11)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM g) WHERE m < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM d, range(13) AS r(k)),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w)+1)) AS i FROM w),
k AS (SELECT x.doc_id, string_agg(x.x, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY 1)
SELECT w.doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

LINKS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i+3] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-2, 2))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id,
  (SELECT count(*) FROM e WHERE e.a = d.doc_id)::bigint AS n_links FROM documents d LEFT JOIN n USING (doc_id)
"""

def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": LINKS, "op4_quality_rules": QUALITY, "op5_warc": REVISITS, "op6_substring_dedup": REPEATS}
