"""SQL for the queries of this package, as DuckDB runs it."""

from __future__ import annotations

_URLS = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), named AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(regexp_extract(rest, '(?s)^[^/?#]*(.*)$', 1), '(?s)^[^?#]*') AS path
    FROM cut
), rules (host, path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
    SELECT page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(verdict, length(r.host || r.path)) AS verdict
    FROM named n JOIN rules r ON ends_with('.' || n.host, '.' || r.host) AND starts_with(n.path, r.path) GROUP BY page_id
), globs (place, pattern, form) AS (
    VALUES (1, '*spam*.*/**', '(?s)[^/]*spam[^/]*[.][^/]*/.*'), (2, '*pills*.*/**', '(?s)[^/]*pills[^/]*[.][^/]*/.*'),
        (3, '*casino*.*/**', '(?s)[^/]*casino[^/]*[.][^/]*/.*'), (4, '*/**.exe', '(?s)[^/]*/.*[.]exe'), (5, '*/**.zip', '(?s)[^/]*/.*[.]zip')
), listed AS (
    SELECT page_id, min_by(pattern, place) AS pattern FROM named n JOIN globs g ON regexp_full_match('.' || n.host || n.path, g.form) GROUP BY page_id
)
SELECT n.page_id, n.host, n.path, f.rule,
    CASE WHEN f.rule IS NOT NULL THEN f.verdict WHEN l.pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
    CASE WHEN f.rule IS NULL THEN l.pattern END AS pattern
FROM named n LEFT JOIN fits f USING (page_id) LEFT JOIN listed l USING (page_id)
"""

_TOPK = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op1_url_filter": _URLS, "op3_maxscore": _TOPK}
