"""Query op7: secrets in all documents, through a ledger that starts empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.secret_ledger import BASE_KINDS, RULES, Ledger, Rule, findings_by_path, scan_new, spans_text
from tessera.sources.shared import shared_path
from tessera.sources.tables import table


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(shared_path(spark, "ledger"))
    scan_new(docs, ledger)
    found = findings_by_path(docs, ledger)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


QUERIES = {"op7_secret_scan": op7_secret_scan}


def _matches_sql(rank: int, rule: Rule) -> str:
    """Rows (doc_id, start, rank, kind, stop) of a rule: the pieces between matches give the positions."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, i, secrets,
        list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0) AS start, length(matches[i]) AS n
      FROM (SELECT doc_id, pieces, matches, secrets, unnest(range(1, len(matches) + 1)) AS i FROM (
        SELECT doc_id, regexp_split_to_array(body, '{pattern}') AS pieces, regexp_extract_all(body, '{pattern}', 0) AS matches, regexp_extract_all(body, '{pattern}', {rule.group}) AS secrets FROM b))
      WHERE length(secrets[i]) >= {rule.least}"""


_SPAN = "string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, rank)"
_BASE = "kind IN ('assign', 'access', 'hex')"
ORACLES = {
    "op7_secret_scan": f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
m AS ({" UNION ALL ".join(_matches_sql(i, r) for i, r in enumerate(RULES))})
SELECT b.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)},
  sha256(coalesce({_SPAN} FILTER ({_BASE}), '')) AS base_sha256, coalesce({_SPAN} FILTER (kind IS NOT NULL), '') AS spans
FROM b LEFT JOIN m ON b.doc_id = m.doc_id GROUP BY b.doc_id
""",
}
