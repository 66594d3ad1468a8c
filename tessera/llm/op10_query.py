"""Query op10: the benchmark passages that each document holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.edit_match import contamination
from tessera.sources.tables import table


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "contaminated", "n_items", F.col("found.item_id").alias("item_ids"), F.col("found.distance").alias("distances")
    )


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
