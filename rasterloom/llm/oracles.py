"""DuckDB SQL that the queries of the training-data operators are checked against."""

from __future__ import annotations

SQL: dict[str, str] = {}

# words and windows counted one by one; hits are joined on the words themselves
SQL["op3_benchmark_decontamination"] = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), gram AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
    FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i)
    WHERE len(w) > 0
), size AS (
    SELECT DISTINCT k FROM gram
), hit AS (
    SELECT r, i, x.k, gram.item_id
    FROM (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
          FROM doc, size, unnest(range(1, len(w) - k + 2)) AS t(i)) AS x
    JOIN gram ON gram.k = x.k AND gram.g = x.g
), word AS (
    SELECT r, count(DISTINCT p) AS n_hit
    FROM (SELECT DISTINCT r, i, k FROM hit), unnest(range(i, i + k)) AS t(p) GROUP BY r
), owner AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN owner USING (r)
"""

SQL["op9_url_filters"] = r"""
WITH rest AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), rules(verdict, h, p) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), best AS (
    SELECT page_id, host, path, (SELECT arg_max(struct_pack(rule := h || p, verdict := verdict), length(h || p)) FROM rules
           WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS b
    FROM split
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best
"""

SQL["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE doc AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingle AS MATERIALIZED (
    SELECT DISTINCT r, md5(array_to_string(w[i : i + 4], ' ')) AS s
    FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), size AS MATERIALIZED (
    SELECT r, count(*) AS n FROM shingle GROUP BY r
), common AS MATERIALIZED (
    SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingle a JOIN shingle b USING (s) WHERE a.r <> b.r GROUP BY ALL
), link AS MATERIALIZED (
    SELECT x, y FROM common JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(x, y) AS (
    SELECT r, r FROM doc UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y
), low AS (
    SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN doc ON doc.r = reach.y GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc JOIN low USING (r) LEFT JOIN size USING (r)
"""

SQL["op5_substring_dedup"] = r"""
WITH doc AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS MATERIALIZED (
    SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM doc, unnest(range(1, len(w) - 48)) AS t(i)
), first AS (
    SELECT g, min(doc_id) AS m FROM win GROUP BY g
), gone AS (
    SELECT DISTINCT r, p FROM (SELECT r, i FROM win JOIN first USING (g) WHERE doc_id > m), unnest(range(i, i + 50)) AS t(p)
), word AS (
    SELECT r, p, w[p] AS word FROM doc, unnest(range(1, len(w) + 1)) AS t(p)
), kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (r, p) GROUP BY r
), lost AS (
    SELECT r, count(*) AS n FROM gone GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""

# every run of one to four words is counted; parts and longer candidates are looked up by their words
SQL["op11_phrase_collocations"] = r"""
WITH piece AS MATERIALIZED (
    SELECT row_number() OVER () AS r, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[.,;:!?\x0A-\x0D]')) AS p
          FROM documents)
), run AS MATERIALIZED (
    SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS g, count(*) AS f
    FROM piece, unnest(range(1, 5)) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i)
    GROUP BY lang, m, g HAVING m = 1 OR count(*) >= 30
), total AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM run WHERE m = 1 GROUP BY lang
), candidate AS MATERIALIZED (
    SELECT lang, m, g, f, string_split(g, ' ') AS w FROM run WHERE m > 1
), cut AS (
    SELECT c.lang, c.g, c.f, c.k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.f // (x.f + y.f) AS BIGINT) AS score
    FROM (SELECT *, concat(lang, chr(9), array_to_string(w[1 : k], ' ')) AS head,
                 concat(lang, chr(9), array_to_string(w[k + 1 : m], ' ')) AS tail
          FROM candidate, unnest(range(1, m)) AS t(k)) AS c
    JOIN (SELECT concat(lang, chr(9), g) AS key, f FROM run) AS x ON x.key = c.head
    JOIN (SELECT concat(lang, chr(9), g) AS key, f FROM run) AS y ON y.key = c.tail
), weakest AS (
    SELECT lang, g AS phrase, f AS a, l, r, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
    SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(f) AS longer
    FROM candidate, unnest(range(2, m)) AS t(k), unnest(range(1, m - k + 2)) AS u(i) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest JOIN total USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""

# every row is scored with every anchor
SQL["op12_hard_negatives"] = r"""
WITH vec AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM vec a JOIN vec b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positive AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""
