"""Queries of the operators over the whole documents table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import alignment, compression, divergence, languages, lines, media, mixing, neardup, packing, rules, scoring, subspaces, tokens
from tickloom.llm.common import table
from tickloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _over_documents(name: str, operator: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: operator(table(configure(spark), folder, "documents"))
    if sql is not None:
        ORACLES[name] = sql


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, ((rk - 1) % 3 + 1)::BIGINT AS weight, (3 * source_size)::BIGINT AS most,
  (3 * source_size)::DOUBLE / ((rk - 1) % 3 + 1) AS ratio FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lev
  FROM w WINDOW b AS (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN ratio < (SELECT arg_min(lev, ratio) FROM l WHERE ratio >= lev)
    THEN most::DOUBLE ELSE (SELECT arg_min(lev, ratio) FROM l WHERE ratio >= lev) * weight END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
k AS (SELECT d.source, d.h, sum(size) AS words FROM d GROUP BY 1, 2),
c AS (SELECT k.*, p.target - p.whole * p.source_size AS rest,
    sum(words) OVER (PARTITION BY k.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS through
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, min(h) AS h FROM c WHERE through > rest GROUP BY source),
x AS (SELECT c.source, c.h + CASE WHEN through - rest < rest - (through - words) THEN 1 ELSE 0 END AS lim
  FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source AND c.h = e.h),
y AS (SELECT d.doc_id, d.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.whole
    + CASE WHEN p.whole < 3 AND coalesce(d.h < x.lim, TRUE) THEN 1 ELSE 0 END ELSE 0 END AS copies
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM y
"""

_LINES = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, o.key IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
c AS (SELECT min(doc_id) AS node, hash(list_sort(sh)) AS hs, any_value(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY 2),
e AS (SELECT node, len(sh) AS n, unnest(sh) AS x FROM c),
i AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * k >= 75 * (na + nb - k)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT node, node FROM c UNION SELECT r.node, t.b FROM r JOIN t ON t.a = r.reach),
m AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id,
  s.doc_id = coalesce(m.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON len(s.sh) > 0 AND hash(list_sort(s.sh)) = c.hs LEFT JOIN m ON m.node = c.node
"""

_COSINE = """
WITH RECURSIVE g AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
v AS (SELECT rid, vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM g
  WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.rid AS a, b.rid AS b, a.vec_id AS va, b.vec_id AS vb FROM v a JOIN v b ON a.rid <> b.rid
  AND CASE WHEN len(a.x) = len(b.x) THEN list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.9 ELSE FALSE END),
n AS (SELECT a AS rid, count(*) AS links FROM l GROUP BY a),
r(node, reach) AS (SELECT DISTINCT va, va FROM l UNION SELECT r.node, l.vb FROM r JOIN l ON l.va = r.reach),
m AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT g.vec_id, coalesce(n.links, 0)::BIGINT AS n_links, coalesce(m.component, g.vec_id) AS component_id,
  g.vec_id = coalesce(m.component, g.vec_id) AS kept
FROM g LEFT JOIN n ON g.rid = n.rid LEFT JOIN m ON g.vec_id = m.node
"""

_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s)::HUGEINT AS p FROM a WINDOW s AS (PARTITION BY lang, source)),
m AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM a GROUP BY lang, term),
q AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s)::HUGEINT AS q FROM m WINDOW s AS (PARTITION BY lang)),
x AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (SELECT i.lang, i.source, 'pair' AS part, j.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g i JOIN g j ON i.lang = j.lang AND i.source <> j.source
  LEFT JOIN x ON x.lang = i.lang AND x.source = i.source AND x.item = j.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

_over_documents("op6_quality_rules", rules.quality)
_over_documents("op7_mixing", mixing.mix, _MIX)
_over_documents("op8_line_dedup", lines.line_report, _LINES)
_over_documents("op4_best_fit_packing", packing.pack)
_over_documents("op10_token_counts", tokens.token_counts)
_over_documents("op5_minhash_near_dedup", neardup.near_duplicates, _NEAR)
_over_documents("op1_language_id", languages.identify)
QUERIES["op9_compression_quality"] = lambda spark, folder: compression.quality_scores(
    table(configure(spark), folder, "documents"), table(spark, folder, "labels")
)
_over_documents("op2_media_columns", media.document_sequences)
_over_documents("op3_context_mixing_score", scoring.language_model_scores)
_over_documents("op11_cross_alignment", alignment.cross_alignment)
QUERIES["op13_subspace_links"] = lambda spark, folder: subspaces.near_vectors(table(configure(spark), folder, "embeddings"))
ORACLES["op13_subspace_links"] = _COSINE
_over_documents("op12_source_divergence", divergence.source_divergence, _DIVERGENCE)
