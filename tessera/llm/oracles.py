"""DuckDB SQL for the queries that SQL can express."""

from tessera.llm.urls import HOST_RULES, PATTERNS

_HITS = " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{v}'" for _, p, v in PATTERNS)
_FITS = " UNION ALL ".join(f"SELECT '{r.partition('/')[0]}' AS h, '/{r.partition('/')[2]}' AS p, '{r}' AS r, '{v}' AS v" for r, v in HOST_RULES)
OP4 = rf"""
WITH rules AS ({_FITS}),
parts AS (SELECT page_id, lower(coalesce(url, '')) AS low, coalesce(strpos(url, '://'), 0) AS k, url FROM pages),
cut AS (SELECT page_id, low, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM parts),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
best AS (SELECT page_id, arg_max(r, length(r)) AS rule, arg_max(v, length(r)) AS verdict FROM h JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(best.verdict, CASE {_HITS} ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best ON best.page_id = h.page_id
"""

ORACLES = {"op4_urls": OP4}
