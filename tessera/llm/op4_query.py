"""Query op4: all pages written to an archive and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.warc_store import read_catalog, write_archive
from tessera.sources.tables import table


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_catalog(spark, write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


QUERIES = {"op4_warc": op4_warc}

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * i + 1}, 5))::INT >> {s} & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
ORACLES = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, html FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM d)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM m
""",
}
