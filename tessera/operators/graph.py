"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch, dealt_anew


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the m of their u; the join can be split at a hot u."""
    return edges.join(dealt_anew(least, "m", "u"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both, least).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    up = _with_least(edges, least).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.union(least.select("u", F.col("m").alias("v"))).distinct()


def forest_roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for (node, parent) rows that make up a forest; roots have no row of their own.

    Every round replaces a parent by its parent, which halves the depth.
    """
    at = scratch.stage(parents.select("node", F.col("parent").alias("root")), "roots")
    while True:
        above = at.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = scratch.stage(
            at.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots"
        )
        at = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return at


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, comp) for the nodes of ``links`` (columns a and b): comp is the least node of the component.

    Each round halves the depth of the trees or better and is written to shared
    storage, where the last one stays (in ``scratch``, if given); only a count and a checksum of the edges reach the driver. No
    group is gathered: minima are pre-aggregated, and the joins on a node with
    very many edges can be split.
    """
    spark = links.sparkSession
    own, last = Scratch(spark), scratch or Scratch(spark)
    edges = own.stage(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == seen or now["n"] == 0:
            break
        seen = (now["n"], now["s"])
        edges = own.stage(_small_star(_large_star(edges)), "edges")
    edges = last.stage(edges, "stars")
    own.clear()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
