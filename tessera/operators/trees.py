"""Trees of folders of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch, stage


def below(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, steps): the seeds (id) and all that lies below them in ``nodes`` (id, parent_id), with the fewest steps to a seed.

    A round joins the nodes with the level found last and is written, so there are as many rounds as levels. A
    node that was found before is not taken up again, which also ends at cycles.
    """
    with Scratch(nodes.sparkSession) as scratch:
        level = scratch.stage(seeds.select("id").distinct().withColumn("steps", F.lit(0)), "level")
        found, steps = level, 0
        while not level.isEmpty():
            steps += 1
            children = nodes.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct()
            level = scratch.stage(children.join(found, "id", "left_anti").withColumn("steps", F.lit(steps)), "level")
            found = found.union(level)
        return stage(found, "below")
