"""Roots that own paths, as equi-joins on ancestor paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import ancestors, dir_name, path_key


def owners_any_case(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """As :func:`owners`, without regard to case, kind of separator and separators at the end of a root."""
    keyed = files.select(dir_name(path_key(F.col(path))).alias("dir_key")).distinct().withColumn("root_key", F.explode(ancestors(F.col("dir_key"), "\\\\")))
    owned = keyed.join(roots.select(F.col("id").alias("root_id"), F.col("root"), path_key(F.col("root")).alias("root_key")), "root_key").drop("root_key")
    return files.withColumn("dir_key", dir_name(path_key(F.col(path)))).join(owned, "dir_key").drop("dir_key")


def owners(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with root_id and root of every root that contains them, a row each.

    Every directory lists its ancestors, and those join with the roots: a
    prefix test becomes a hash join, whatever the number of roots. Directories
    are joined once and files follow, since many files share one.
    """
    directories = files.select(dir_name(F.col(path)).alias("_dir")).distinct()
    listed = directories.withColumn("root", F.explode(ancestors(F.col("_dir"))))
    owned = listed.join(roots.select(F.col("id").alias("root_id"), F.col("root")), "root")
    return files.withColumn("_dir", dir_name(F.col(path))).join(owned, "_dir").drop("_dir")


def longest_owner(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with the id of the longest root that contains them, null without one; the least id on ties."""
    directories = files.select(dir_name(F.col(path)).alias("_dir")).distinct()
    listed = directories.withColumn("root", F.explode(ancestors(F.col("_dir"))))
    best = (
        listed.join(roots.select(F.col("id").alias("root_id"), F.col("root")), "root")
        .groupBy("_dir")
        .agg(F.max(F.struct(F.char_length("root").alias("n"), (-F.col("root_id")).alias("m"))).alias("best"))
        .select("_dir", (-F.col("best.m")).alias("owner_id"))
    )
    return files.withColumn("_dir", dir_name(F.col(path))).join(best, "_dir", "left").drop("_dir")
