"""Query op6: near-duplicate class of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.near_dedup import near_duplicates
from tessera.sources.tables import table


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "class_texts", "is_keeper")


QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLES: dict[str, str] = {}
