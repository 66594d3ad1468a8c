"""Query op12: the divergence of all sources of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.divergence import source_divergence
from tessera.sources.tables import table


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), min_docs=10, most_terms=10)


QUERIES = {"op12_source_divergence": op12_source_divergence}

ORACLES = {
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), o AS (
  SELECT doc, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS c FROM o JOIN kept USING (lang, term) GROUP BY ALL
), all_c AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 2)) // ((sum(c) OVER (PARTITION BY lang, source))::HUGEINT + 2 * v))::BIGINT AS p FROM all_c JOIN v USING (lang)
), q AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (c + 2)) // ((sum(c) OVER (PARTITION BY lang))::HUGEINT + 2 * v))::BIGINT AS q
  FROM (SELECT lang, term, sum(c) AS c FROM all_c GROUP BY ALL) JOIN v USING (lang)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT p.lang, source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
}
