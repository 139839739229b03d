"""SQL of the registered queries that SQL can express."""

from __future__ import annotations

import math

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * (SELECT sum(size) FROM d) AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT (SELECT min_by(level, cap / w) FROM l WHERE cap > level * w) AS free),
t AS (SELECT source, source_size, CASE WHEN free IS NULL THEN cap ELSE least(cap, free * w) END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(2, floor(target / source_size)) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest, p.source,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS here
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN passes < 2 AND (upto <= rest OR (upto > rest AND upto - here <= rest AND rest - (upto - here) >= here / 2)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""

OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m))),
c AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE m = 1 GROUP BY lang),
k AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM c WHERE m > 1 AND f >= 100),
inside AS (SELECT lang, array_to_string(list_slice(ws, i, i + j - 1), ' ') AS phrase, max(f) AS longer
           FROM (SELECT lang, ws, m, f, j, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM k)) GROUP BY ALL),
kept AS (SELECT k.* FROM k LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * f),
cuts AS (SELECT lang, phrase, f, cut, array_to_string(list_slice(ws, 1, cut), ' ') AS front, array_to_string(list_slice(ws, cut + 1, m), ' ') AS rear
         FROM (SELECT *, unnest(range(1, m)) AS cut FROM kept)),
scored AS (SELECT x.lang, x.phrase, x.f AS a, x.cut, l.f AS l, r.f AS r, n.n, (1000 * x.f * n.n) // (l.f * r.f) AS score
           FROM cuts x JOIN c l ON l.lang = x.lang AND l.phrase = x.front JOIN c r ON r.lang = x.lang AND r.phrase = x.rear JOIN n ON n.lang = x.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def _rule_cases(rules: list[tuple[str, str]], what: int) -> str:
    """The longest rule that fits, or its verdict."""
    cases = []
    for rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule[1].partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule[what]}'")
    return f"CASE {' '.join(cases)} END"


def op11_sql(rules: list[tuple[str, str]], depth: int = 8, least: int = 5, share: float = 0.05, weight: float = 10.0, doubt: float = 0.05, threshold: float = 0.5) -> str:
    """The template tree level by level, each level four tables."""
    out = [f"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
pg AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, host, path, {_rule_cases(rules, 1)} AS rule, {_rule_cases(rules, 0)} AS by_rule FROM pg),
q AS (SELECT host, path, count(*) AS n, count(rule) AS labelled, count(CASE WHEN by_rule = 'block' THEN 1 END) AS blocked,
             CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END AS s FROM r GROUP BY host, path),
t0 AS (SELECT host, path, n, labelled, blocked, CASE WHEN len(s) > {depth} THEN list_append(s[1:{depth - 1}], array_to_string(s[{depth}:], '/')) ELSE s END AS segs,
              CAST([] AS VARCHAR[]) AS nodes FROM q)"""]
    for k in range(1, depth + 1):
        out.append(f"""a{k} AS (SELECT *, segs[{k}] AS seg, regexp_replace(segs[{k}], '[0-9]+', '{{n}}', 'g') AS shape FROM t{k - 1}),
s{k} AS (SELECT host, nodes, seg, any_value(shape) AS shape, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY host, nodes) AS here FROM a{k} WHERE seg IS NOT NULL GROUP BY host, nodes, seg),
l{k} AS (SELECT *, n >= {least} AND n >= here * {share}::DOUBLE AS literal FROM s{k}),
h{k} AS (SELECT host, nodes, shape, sum(n) >= {least} AND sum(n) >= any_value(here) * {share}::DOUBLE AS shaped FROM l{k} WHERE NOT literal GROUP BY host, nodes, shape),
t{k} AS (SELECT a.host, a.path, a.n, a.labelled, a.blocked, a.segs,
                CASE WHEN a.seg IS NULL THEN a.nodes WHEN l.literal THEN list_append(a.nodes, '=' || a.seg) WHEN h.shaped THEN list_append(a.nodes, a.shape) ELSE list_append(a.nodes, '{{any}}') END AS nodes
         FROM a{k} a LEFT JOIN l{k} l USING (host, nodes, seg) LEFT JOIN h{k} h ON h.host = a.host AND h.nodes = a.nodes AND h.shape = a.shape)""")
    out.append(f"""leaf AS (SELECT host, nodes AS leaf, sum(n) AS pages, sum(labelled) AS labelled, sum(blocked) AS blocked FROM t{depth} GROUP BY ALL),
base AS (SELECT (coalesce(sum(blocked), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS p FROM leaf),
below AS (SELECT *, leaf[1:level] AS node, coalesce(array_to_string(leaf[level + 1:], '/'), '') AS rest FROM (SELECT *, unnest(range(0, len(leaf) + 1)) AS level FROM leaf)),
ends AS (SELECT host, node, level, rest, sum(pages) AS pages, sum(labelled) AS labelled, sum(blocked) AS blocked FROM below GROUP BY ALL),
nodes AS (SELECT host, node, level, node[1:greatest(level - 1, 0)] AS above, sum(pages) AS pages, sum(labelled) AS labelled, sum(blocked) AS blocked,
                 last(rest ORDER BY pages, rest) AS shape, max(pages) AS most FROM ends GROUP BY host, node, level),
own AS (SELECT *, labelled > 0 AS known, CASE WHEN labelled > 0 THEN blocked::DOUBLE / labelled::DOUBLE ELSE 0 END AS own, most::DOUBLE / pages::DOUBLE AS alike FROM nodes),
lagged AS (SELECT *, lag(own) OVER w AS own0, lag(alike) OVER w AS alike0, lag(pages) OVER w AS pages0, lag(labelled) OVER w AS labelled0 FROM own
           WINDOW w AS (PARTITION BY host, level, above, shape, known ORDER BY own, node)),
broken AS (SELECT *, CASE WHEN pages0 IS NULL THEN 0
                          WHEN abs(alike - alike0) > {math.sqrt(math.log(2 / doubt) / 2)!r} * (1 / sqrt(pages::DOUBLE) + 1 / sqrt(pages0::DOUBLE)) THEN 1
                          WHEN known AND abs(own - own0) > {math.sqrt(math.log(2 / doubt) / 2)!r} * (1 / sqrt(labelled::DOUBLE) + 1 / sqrt(labelled0::DOUBLE)) THEN 1 ELSE 0 END AS new FROM lagged),
branches AS (SELECT *, sum(new) OVER (PARTITION BY host, level, above, shape, known ORDER BY own, node ROWS UNBOUNDED PRECEDING) AS branch FROM broken),
merged AS (SELECT host, node, level, above, sum(labelled) OVER b AS n, sum(blocked) OVER b AS k FROM branches WINDOW b AS (PARTITION BY host, level, above, shape, known, branch)),
share AS (SELECT host, node, level, (k + p * {weight}::DOUBLE) / (n + {weight}::DOUBLE) AS p, n > 0 AS seen FROM merged, base WHERE level = 0
          UNION ALL SELECT m.host, m.node, m.level, (m.k + s.p * {weight}::DOUBLE) / (m.n + {weight}::DOUBLE), s.seen FROM share s JOIN merged m ON m.host = s.host AND m.level = s.level + 1 AND m.above = s.node)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.by_rule, CASE WHEN s.seen AND s.p >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(array_to_string(t.nodes, '/'), '') AS template
FROM r JOIN t{depth} t ON t.host = r.host AND t.path = r.path JOIN share s ON s.host = t.host AND s.node = t.nodes""")
    return ",\n".join(out)
