"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import quality_rules as Q

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9 = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
w AS (
  SELECT page_id, u.host, u.path, r.action, r.host || r.path AS rule
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(action, length(rule)), 'allow') AS verdict
FROM w GROUP BY page_id, host, path
"""

OP7 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM bi),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM b) WHERE len(w) >= m),
d AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM di),
hit AS (SELECT DISTINCT d.doc_id, d.m, d.i, b.item_id FROM d JOIN b USING (m, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP1 = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM t WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.m = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

_STATS = rf"""
t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM DOCUMENTS_TABLE),
ln AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln GROUP BY doc_id),
wi AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
rp AS (SELECT doc_id, i FROM wi QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rc AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rp) GROUP BY doc_id),
s AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM t LEFT JOIN lc USING (doc_id) LEFT JOIN rc USING (doc_id)),
s2 AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
"""


def _bucket(v: str) -> str:
    e = f"greatest(length(bin({v})) - 5, 0)"
    return f"({e} * 16 + ({v} >> {e}))"


def _floor(b: str) -> str:
    return f"(CASE WHEN {b} < 32 THEN {b} ELSE ({b} % 16 + 16) << greatest({b} // 16 - 1, 0)::INT END)"


def _quality(tbl: str) -> str:
    value = {m: f"(({scale} * {num}) // greatest({den}, 1))" for m, (num, den, scale, _, _) in Q.METRICS.items()}
    vals = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, {_bucket(v)} AS bucket FROM s2 WHERE NOT base_failed" for m, v in value.items())
    bad, cols = [], []
    for m, (_, _, _, slack, lower) in Q.METRICS.items():
        for x in ("q1", "q3"):
            cols.append(f"CASE WHEN a.n_{m} >= {Q.MIN_GROUP} THEN a.{x}_{m} WHEN b.n_{m} >= {Q.MIN_GROUP} THEN b.{x}_{m} ELSE c.{x}_{m} END AS {x}_{m}")
        bad.append(f"coalesce({value[m]} > q3_{m} + {Q.SPREAD} * (q3_{m} - q1_{m}) + {slack}, false)")
        if lower:
            bad.append(f"coalesce({value[m]} < q1_{m} - {Q.SPREAD} * (q3_{m} - q1_{m}) - {slack}, false)")
    wide = ", ".join(f"max(total) FILTER (metric = '{m}') AS n_{m}, max(q1) FILTER (metric = '{m}') AS q1_{m}, max(q3) FILTER (metric = '{m}') AS q3_{m}" for m in Q.METRICS)
    return f"""{_STATS.replace("DOCUMENTS_TABLE", tbl)},
v AS ({vals}),
lv AS (SELECT 0 AS level, lang, source, metric, bucket FROM v UNION ALL SELECT 1, lang, NULL, metric, bucket FROM v UNION ALL SELECT 2, NULL, NULL, metric, bucket FROM v),
h AS (SELECT level, lang, source, metric, bucket, count(*) AS n FROM lv GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS cum FROM h),
q0 AS (SELECT level, lang, source, metric, max(total) AS total, min(bucket) FILTER (4 * cum >= total) AS b1, min(bucket) FILTER (4 * cum >= 3 * total) AS b3 FROM cu GROUP BY ALL),
q AS (SELECT level, lang, source, metric, total, {_floor("b1")} AS q1, {_floor("b3")} AS q3 FROM q0),
wd AS (SELECT level, lang, source, {wide} FROM q GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM s2),
f AS (SELECT g.lang AS f_lang, g.source AS f_source, {", ".join(cols)} FROM g
  LEFT JOIN (SELECT * FROM wd WHERE level = 0) a ON g.lang IS NOT DISTINCT FROM a.lang AND g.source IS NOT DISTINCT FROM a.source
  LEFT JOIN (SELECT * FROM wd WHERE level = 1) b ON g.lang IS NOT DISTINCT FROM b.lang
  LEFT JOIN (SELECT * FROM wd WHERE level = 2) c ON true),
judged AS (SELECT s2.*, NOT base_failed AND NOT ({" OR ".join(bad)}) AS kept
  FROM s2 LEFT JOIN f ON lang IS NOT DISTINCT FROM f_lang AND source IS NOT DISTINCT FROM f_source)"""


OP10 = f"WITH {_quality('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"

ORACLES = {"op1_ngram_jaccard": OP1, "op7_decontamination": OP7, "op9_url_filter": OP9, "op10_quality_rules": OP10}
