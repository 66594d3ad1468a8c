"""Query op8: rate and copies of every document for the target mixture of domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.mixing import mix_sources
from tessera.sources.tables import table

#: A domain below its target is repeated up to so many times.
MAX_RATE = 5.0


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix_sources(docs, table(spark, sf_dir, "labels"), max_rate=MAX_RATE).select("doc_id", "n_tokens", "p_clean", "p_toxic", "p_junk", "rate", "copies")


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
