"""Groups of equal files: keepers, reclaimable bytes, deletable paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.numbering import numbered
from tessera.sources.shared import dealt_anew


def exact_groups(files: DataFrame, size: str = "size", content: str = "content") -> DataFrame:
    """``files`` of equal content, with digest and copies; only sizes that occur twice are hashed."""
    crowded = files.groupBy(size).agg(F.count("*").alias("_n")).where("_n > 1").select(size)
    hashed = files.join(crowded, size, "left_semi").withColumn("digest", F.sha2(F.col(content), 256)).drop(content)
    repeated = hashed.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    return hashed.join(dealt_anew(repeated, "copies", "digest"), "digest")


def ranked_members(groups: DataFrame, group: str = "digest") -> DataFrame:
    """Members of each group in keeper order: pixels, then bytes, then age, then path."""
    keyed = groups.withColumn("_p", -F.col("pixels")).withColumn("_s", -F.col("size"))
    return numbered(keyed, [group], ["_p", "_s", "modified", "path"]).withColumn("place", F.col("place") + 1).drop("_p", "_s")


def keepers(groups: DataFrame, group: str = "digest") -> DataFrame:
    """(group, keep_path, keep_dir) by aggregation, so that a group of very many copies is never sorted."""
    key = F.struct((-F.col("pixels")).alias("p"), (-F.col("size")).alias("s"), F.col("modified"), F.col("path"), F.col("dir"))
    return groups.groupBy(group).agg(F.min(key).alias("k")).select(group, F.col("k.path").alias("keep_path"), F.col("k.dir").alias("keep_dir"))


def deletable(groups: DataFrame, group: str = "digest") -> DataFrame:
    """Members that may go: neither the keeper nor in the keeper's folder; of equal paths (any case) one."""
    single = groups.groupBy(group, F.lower("path").alias("_p")).agg(F.min(F.struct("path", "dir", "size")).alias("m")).select(group, "m.*")
    return single.join(keepers(groups, group), group).where((F.col("path") != F.col("keep_path")) & (F.lower("dir") != F.lower("keep_dir")))
