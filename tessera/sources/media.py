"""Files of a media folder as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import base_name, dir_name, media_kind


def scan_files(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(path, dir, name, kind, size, modified[, content]) of all files below ``root`` without hidden parts; kind is null for other files.

    Contents are read only if asked for: the scan of names and sizes never opens a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    shown = files.withColumn("path", path).where(~F.col("path").rlike(r"/\."))
    columns = [
        F.col("path"), dir_name(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name"), media_kind(F.col("path")).alias("kind"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    ]
    return shown.select(*columns, *(["content"] if with_content else []))


def media_files(spark: SparkSession, root: str) -> DataFrame:
    return scan_files(spark, root).where("kind is not null")


def folder_totals(files: DataFrame) -> DataFrame:
    """Bytes, files by kind and cover of each folder: its first image, else animated image, else video."""

    def first(kind: str):
        return F.min(F.when(F.col("kind") == kind, F.col("path")))

    return files.groupBy("dir").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("image", "animated", "video")),
        F.coalesce(first("image"), first("animated"), first("video")).alias("cover"),
    )


def distinct_files(files: DataFrame, identity: str, album: str = "album_id") -> DataFrame:
    """One row for each real file reached through several roots, that of the least album."""
    rest = [c for c in files.columns if c not in (identity, album)]
    return files.groupBy(identity).agg(F.min(F.struct(album, *rest)).alias("_r")).select(identity, "_r.*")


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the lines appended to the log files of a folder."""
    return spark.readStream.text(folder)
