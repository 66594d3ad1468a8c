"""Duplicate groups over documents: a document stands for a file, its source for the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.duplicates import deletable, exact_groups, keepers, ranked_members
from tessera.sources.tables import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("path"),
        F.concat(F.lit("/"), F.col("source")).alias("dir"),
        F.coalesce("n_chars", F.lit(0)).alias("size"),
        (F.col("doc_id") % 3).alias("pixels"),
        (F.col("doc_id") % 7).alias("modified"),
        F.coalesce("text", F.lit("")).alias("content"),
    )


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(_files(spark, sf_dir))
    return groups.groupBy("digest").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.sum("size").alias("bytes"))


def dup_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keepers(exact_groups(_files(spark, sf_dir))).select("digest", "keep_path")


def dup_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_members(exact_groups(_files(spark, sf_dir))).select("digest", "place", "path")


def deletable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletable(exact_groups(_files(spark, sf_dir))).select("digest", "path")


def folder_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each group by folder, the keeper's folder marked."""
    groups = exact_groups(_files(spark, sf_dir))
    cells = groups.groupBy("digest", "dir").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return cells.join(keepers(groups), "digest").select("digest", "dir", "n", "bytes", (F.col("dir") == F.col("keep_dir")).alias("keep_folder"))


def dedupe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with something to delete, by reclaimable bytes."""
    doomed = deletable(exact_groups(_files(spark, sf_dir)))
    return doomed.groupBy("digest", "keep_path").agg(F.count("*").alias("n"), F.sum("size").alias("reclaimable")).orderBy(F.desc("reclaimable"), "digest")


def reclaimable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = deletable(exact_groups(_files(spark, sf_dir)))
    return doomed.agg(F.countDistinct("digest").alias("groups"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


QUERIES = {f.__name__: f for f in (exact_dup_groups, dup_keeper, dup_ranking, deletable_paths, folder_cells, dedupe_report, reclaimable_bytes)}

_G = """files AS (SELECT '/' || source || '/' || doc_id AS path, '/' || source AS dir, coalesce(n_chars, 0) AS size, doc_id % 3 AS pixels, doc_id % 7 AS modified,
      sha256(coalesce(text, '')) AS digest FROM documents),
    g AS (SELECT *, count(*) OVER (PARTITION BY digest) AS copies, row_number() OVER (PARTITION BY digest ORDER BY pixels DESC, size DESC, modified, path)::INT AS place FROM files QUALIFY copies > 1),
    k AS (SELECT digest, path AS keep_path, dir AS keep_dir FROM g WHERE place = 1),
    doomed AS (SELECT g.*, keep_path FROM g JOIN k USING (digest) WHERE path <> keep_path AND dir <> keep_dir)"""
ORACLES = {
    "exact_dup_groups": f"WITH {_G} SELECT digest, count(*) AS copies, min(path) AS first_path, sum(size)::BIGINT AS bytes FROM g GROUP BY 1",
    "dup_keeper": f"WITH {_G} SELECT digest, keep_path FROM k",
    "dup_ranking": f"WITH {_G} SELECT digest, place, path FROM g",
    "deletable_paths": f"WITH {_G} SELECT digest, path FROM doomed",
    "folder_cells": f"WITH {_G} SELECT g.digest, dir, count(*) AS n, sum(size)::BIGINT AS bytes, dir = keep_dir AS keep_folder FROM g JOIN k USING (digest) GROUP BY g.digest, dir, keep_dir",
    "dedupe_report": f"WITH {_G} SELECT digest, keep_path, count(*) AS n, sum(size)::BIGINT AS reclaimable FROM doomed GROUP BY 1, 2",
    "reclaimable_bytes": f"WITH {_G} SELECT count(DISTINCT digest) AS groups, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM doomed",
}
