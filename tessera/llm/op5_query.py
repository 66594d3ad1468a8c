"""Query op5: quality counts and verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.quality import COLUMNS, score_documents
from tessera.sources.tables import table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, sf_dir, "labels")).drop("text").select("doc_id", *COLUMNS)


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
