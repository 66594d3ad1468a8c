"""Query op9: language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.interpolated_lm import DELETED, HELD_OUT, TRAIN, score_corpus
from tessera.sources.tables import table

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    part = F.when(fold == 2, HELD_OUT).when(fold == 3, DELETED).otherwise(TRAIN)
    return score_corpus(docs, part).select(*COLUMNS)


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
ORACLES: dict[str, str] = {}
