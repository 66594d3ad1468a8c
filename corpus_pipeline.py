"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes (spark, docs, sf_dir) and works on everything that its
predecessor kept; between stages the documents are written as Parquet and
reread, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.edit_match import contamination
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.quality import score_documents
from tessera.llm.sharding import shard_documents
from tessera.sources.shared import stage
from tessera.sources.tables import table

SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return score_documents(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of least id."""
    return near_duplicates(docs).where("is_keeper").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate for the target mixture says: at most once, since rates end at one."""
    mixed = mix_sources(docs, table(spark, sf_dir, "labels"), max_rate=1.0)
    return mixed.where("copies > 0").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, slot and the shard after one more is appended."""
    return shard_documents(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Classifier, sketches and likelihood ratios are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
