"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
    AND list_bool_or(list_transform(embedding, lambda e: e <> 0))
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0 AND len(q.x) = len(c.x)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 80 * (na.n + nb.n - m)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def _shared(name: str, children: str, parent: str, keys: list[str]) -> str:
    """A level's grants: children (cap, w) of a parent (budget) by weight, at most cap, what is over to siblings."""
    above, own = keys[:-1], keys[-1]
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    join = f"JOIN {parent} p USING ({', '.join(above)})" if above else f"CROSS JOIN {parent} p"
    return f"""{name}_r AS (
  SELECT c.*, p.budget, CASE WHEN w > 0 THEN cap / w ELSE 0.0 END AS ratio FROM {children} c {join}
), {name}_s AS (
  SELECT *, sum(cap) OVER ({part} ORDER BY ratio, {own}) - cap AS before,
    sum(w) OVER ({part}) - sum(w) OVER ({part} ORDER BY ratio, {own}) + w AS after FROM {name}_r
), {name}_f AS (SELECT *, ratio * after <= budget - before AS full_ FROM {name}_s
), {name} AS (
  SELECT {', '.join(keys)}, CASE WHEN full_ THEN cap ELSE
    w * (budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({part})) / nullif(sum(CASE WHEN full_ THEN 0.0 ELSE w END) OVER ({part}), 0) END AS budget
  FROM {name}_f
)"""


OP4 = rf"""
WITH r AS (
  SELECT doc_id, 'domain' || ((strpos('0123456789abcdef', substr(md5(coalesce(d.source, '(none)')), 1, 1)) - 1) % 4)::VARCHAR AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(d.source, '(none)') AS source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM documents d
), leaf AS (
  SELECT domain, lang, source, sum(tokens)::DOUBLE AS supply, 2 * sum(tokens)::DOUBLE AS cap, 1.0::DOUBLE AS w FROM r GROUP BY ALL
), tongue AS (
  SELECT domain, lang, w, CASE WHEN w > 0 THEN cap ELSE 0 END AS cap FROM (
    SELECT domain, lang, sum(cap) AS cap, (CASE lang WHEN 'en' THEN 3.0 WHEN 'de' THEN 1.0 WHEN 'fr' THEN 1.0 WHEN 'es' THEN 1.0 ELSE 0.0 END)::DOUBLE AS w FROM leaf GROUP BY ALL)
), field AS (SELECT domain, sum(cap) AS cap, 1.0::DOUBLE AS w FROM tongue GROUP BY ALL
), root AS (SELECT 0.6::DOUBLE * sum(supply) AS budget FROM leaf
), {_shared("b1", "field", "root", ["domain"])}
, {_shared("b2", "tongue", "b1", ["domain", "lang"])}
, {_shared("b3", "leaf", "b2", ["domain", "lang", "source"])}
, plan AS (SELECT domain, lang, source, floor(b3.budget + 1e-6) AS budget, supply FROM b3 JOIN leaf USING (domain, lang, source) WHERE supply > 0
), e AS (
  SELECT r.*, p.budget, p.supply, unnest(range(0, 1 + least(1, floor(p.budget / p.supply))::BIGINT)) AS epoch
  FROM r JOIN plan p USING (domain, lang, source) WHERE tokens > 0
), o AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('0:' || epoch::VARCHAR || ':' || doc_id::VARCHAR), tokens ROWS UNBOUNDED PRECEDING) - tokens AS start FROM e
)
SELECT doc_id, domain, lang, source, least(tokens, least(supply, budget - epoch * supply) - start)::BIGINT AS tokens, epoch, start::BIGINT AS start
FROM o WHERE start < least(supply, budget - epoch * supply)
"""

OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), p AS (SELECT r, list_concat([' ', ' '], ws) AS ws FROM d
), i AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM p
), t AS (SELECT r, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM i
), c3 AS (SELECT a, b, c, count(*) AS n FROM t GROUP BY ALL
), c2 AS (SELECT b, c, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT ' ', ' ', count(*) FROM d
), c1 AS (SELECT c, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT ' ', 2 * count(*) FROM d
), s AS (
  SELECT t.r, CASE WHEN c3.n >= 2 THEN ln(c3.n / x2.n) WHEN c2.n >= 2 THEN ln(0.4) + ln(c2.n / x1.n) ELSE 2 * ln(0.4) + ln(c1.n / (SELECT count(*) FROM t)) END AS s
  FROM t JOIN c3 USING (a, b, c) JOIN c2 ON c2.b = t.b AND c2.c = t.c JOIN c1 ON c1.c = t.c
    JOIN c2 x2 ON x2.b = t.a AND x2.c = t.b JOIN c1 x1 ON x1.c = t.b
), u AS (SELECT r, sum(s) AS s FROM s GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(u.s, 0.0)::DOUBLE, 6) + 0.0 AS log_score, round((u.s / nullif(len(ws), 0))::DOUBLE, 6) + 0.0 AS mean_log_score FROM d LEFT JOIN u USING (r)
"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
    AND list_bool_or(list_transform(embedding, lambda e: e <> 0))
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ann": OP1, "op2_minhash": OP2, "op4_mixing": OP4, "op6_lm": OP6, "op8_capfilter": OP8}
