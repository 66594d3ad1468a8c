"""Query op1: all documents in shards 0 to 15."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.sharding import shard_documents
from tessera.sources.tables import table

SHARDS = 16
COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _narrow(table(spark, sf_dir, "documents"))


def _narrow(docs: DataFrame) -> DataFrame:
    return shard_documents(docs.select("doc_id", "text"), SHARDS).select(*COLUMNS)


QUERIES = {"op1_sharding": op1_sharding}


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text; ``crc_table`` has the 256 remainders."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"


ORACLES = {
    "op1_sharding": f"""
WITH crc_table AS (
  SELECT list(list_reduce([i::BIGINT] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table
), k AS (
  SELECT d.*, {_crc32("coalesce(doc_id::VARCHAR, '') || '|' || text_crc32 || '|' || size")} % 1024 AS bucket,
    list_reduce([{{'k': (coalesce(doc_id, 0)::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END)::UHUGEINT, 'b': -1::BIGINT, 'j': 0::BIGINT}}]
        || list_transform(range({SHARDS}), lambda x: {{'k': 0::UHUGEINT, 'b': 0::BIGINT, 'j': 0::BIGINT}}),
      lambda s, x: CASE WHEN s.j >= {SHARDS} THEN s ELSE {{'k': (s.k * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT, 'b': s.j,
        'j': floor((s.j + 1) * (2147483648.0::DOUBLE / (((s.k * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT) // 8589934592::UHUGEINT + 1)::DOUBLE))::BIGINT}} END) AS state
  FROM d, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, state.b::INT AS shard,
  row_number() OVER (PARTITION BY state.b ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CASE WHEN state.j = {SHARDS} THEN {SHARDS} ELSE state.b END::INT AS grown_shard
FROM k
""",
}
