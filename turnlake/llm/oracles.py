"""DuckDB statements for the queries of this folder that SQL expresses."""

from __future__ import annotations

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
    SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (
    SELECT vec_id AS node, vec_id AS c FROM embeddings
    UNION
    SELECT p.b, r.c FROM r JOIN p ON r.node = p.a),
g AS (SELECT node, min(c) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN g ON g.node = vec_id LEFT JOIN n ON n.a = vec_id
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
    SELECT doc_id, CASE WHEN coalesce(len(words), 0) = 0 THEN [] ELSE list_distinct(list_transform(
               range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i+3], ' '))) END AS l FROM w),
n AS (SELECT doc_id, len(l)::BIGINT AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(l) AS t FROM s),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles
    HAVING 100 * count(*) >= 85 * (na.n_shingles + nb.n_shingles - count(*))),
r AS (
    SELECT doc_id AS node, doc_id AS c FROM n
    UNION
    SELECT p.b, r.c FROM r JOIN p ON r.node = p.a)
SELECT doc_id, n_shingles, min(c) AS component_id FROM n JOIN r ON r.node = doc_id GROUP BY doc_id, n_shingles
"""

LEXICAL_SEARCH = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
n AS (SELECT r, doc_id, len(words) AS n FROM d WHERE len(words) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM n, s),
q AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL),
t AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
p AS (
    SELECT item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score, any_value(doc_id) AS doc_id
    FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM p WHERE score > 0 QUALIFY rank <= 10
"""
