"""Plans for copying files: target folders and names without collisions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import base_name
from tessera.functions.text import folder_name
from tessera.operators.clustering import in_sequence
from tessera.operators.numbering import numbered
from tessera.sources.shared import dealt_anew, stage


#: A name as stem and extension; the dot of a hidden file begins none. A name that another file's suffix may give, as stem, number and extension.
PARTS, NUMBERED = r"^(.+?)(\.[^.]*)?$", r"^(.+)_([1-9][0-9]{0,17})(\.[^.]*)?$"


def _skipper() -> Callable:
    """Steps through the numbers of a family that other files go by: is the number skipped, and which file of the family meets it?"""
    skipped = 0

    def step(row) -> tuple[int, bool, bool]:
        nonlocal skipped
        meets = row.number - skipped
        there = meets <= row.n - (not row.lost)
        skips = there and meets > row.before - (not row.lost and row.before > 0)
        skipped += skips
        return meets, skips, there and not skips

    return step


def _met(families: DataFrame, edges: DataFrame, lost: DataFrame) -> DataFrame:
    """(family, child, meets, skips, loses) of the numbers that are also the name of a file: the family skips one whose file came before, else that file loses its name."""
    told = edges.join(lost.select(F.col("name").alias("family"), F.lit(True).alias("lost")), "family", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))

    def answered(pdf: pd.DataFrame, answers: list[tuple[int, bool, bool]]) -> pd.DataFrame:
        meets, skips, loses = zip(*answers, strict=True)
        return pd.DataFrame({"family": pdf["family"], "child": pdf["child"], "meets": meets, "skips": skips, "loses": loses})

    return in_sequence(told, "family", [F.asc("number")], _skipper, answered, "family string, child string, meets long, skips boolean, loses boolean")


def unique_names(files: DataFrame, taken: DataFrame | None = None, path: str = "path") -> DataFrame:
    """``files`` with target: in order of path each gets its name, or else the first of ``stem_1.ext``, ``stem_2.ext``, ... that is free.

    ``taken`` (name) are names that were there before. Files of one name are a family, numbered by path in as many tasks as
    they fill. Two families can want the same name only where it is the own name of one (``a_1.jpg``) and a number of the
    other (``a.jpg``, 1), and then whoever comes first has it: of the one family its first file, of the other the file
    that gets to this number. What a family keeps thus depends on the family whose number it is, which is settled in rounds,
    as many as numbers follow each other in names (a_1_1.jpg); only such names take part. Equal paths get names in any order.
    """
    spark = files.sparkSession
    rows = numbered(files.withColumn("_name", base_name(F.col(path))), ["_name"], [path], "_place")
    known = spark.createDataFrame([], "name string") if taken is None else taken.select("name").where("name is not null").distinct()
    counts = rows.groupBy(F.col("_name").alias("name")).agg(F.count("*").alias("n"), F.min(path).alias("first"))
    families = stage(counts.join(known.withColumn("there", F.lit(True)), "name", "full_outer").select("name", F.coalesce("n", F.lit(0)).alias("n"), "first", F.coalesce("there", F.lit(False)).alias("there")), "families")
    parents = F.concat(F.regexp_extract("name", NUMBERED, 1), F.regexp_extract("name", NUMBERED, 3))
    children = families.where(F.col("name").rlike(NUMBERED)).select(parents.alias("family"), F.regexp_extract("name", NUMBERED, 2).cast("long").alias("number"), F.col("name").alias("child"), "first", "there")
    edges = stage(children.join(families.where("n > 0").select(F.col("name").alias("family"), "n"), "family"), "edges")
    gone = families.where("there").select("name")
    files_of = rows.select(F.col("_name").alias("family"), F.col("_place").alias("place"))
    if edges.isEmpty():
        skips = spark.createDataFrame([], "family string, meets long")
    else:
        # of each such number, how many files of its family come before the first file of that name
        asked = edges.where("not there").select("family", F.col("first").alias("at"), F.lit(1).alias("asks"), "child")
        own = rows.join(asked.select(F.col("family").alias("_name")).distinct(), "_name", "left_semi").select(F.col("_name").alias("family"), F.col(path).alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("string").alias("child"))
        among = numbered(own.union(asked), ["family"], ["at", "asks", "child"], "all_before").where("asks = 1")
        before = among.join(numbered(asked, ["family"], ["at", "asks", "child"], "asked_before").select("family", "child", "asked_before"), ["family", "child"])
        edges = stage(edges.join(before.select("family", "child", (F.col("all_before") - F.col("asked_before")).alias("before")), ["family", "child"], "left").fillna({"before": 0}), "edges")
        seen = None
        while True:
            met = stage(_met(families, edges, gone), "met")
            gone = families.where("there").select("name").union(met.where("loses").select(F.col("child").alias("name"))).distinct()
            now = gone.agg(F.count("*"), F.sum(F.xxhash64("name").cast("decimal(38,0)"))).first()
            if now == seen:
                break
            seen = now
        skips = met.where("skips").select("family", "meets")
    ranked = files_of.join(gone.select(F.col("name").alias("family"), F.lit(1).alias("lost")), "family", "left").select("family", "place", (F.col("place") + F.coalesce("lost", F.lit(0))).alias("rank"))
    # the skipped numbers in line with the files: a place in that line is a number
    line = ranked.where("rank > 0").join(dealt_anew(skips.select("family").distinct(), "family"), "family", "left_semi").select("family", F.col("rank").alias("at"), F.lit(1).alias("is_file"), "place")
    moved = numbered(line.union(skips.select("family", "meets", F.lit(0), F.lit(None).cast("long"))), ["family"], ["at", "is_file"], "number").where("is_file = 1")
    given = ranked.join(moved.select("family", "place", (F.col("number") + 1).alias("number")), ["family", "place"], "left").select(F.col("family").alias("_name"), F.col("place").alias("_place"), F.coalesce("number", "rank").alias("_i"))
    stem = F.regexp_extract("_name", PARTS, 1)
    target = F.when(F.col("_i") == 0, F.col("_name")).otherwise(F.concat(stem, F.lit("_"), F.col("_i"), F.expr("substring(_name, char_length(regexp_extract(_name, '^(.+?)([.][^.]*)?$', 1)) + 1)")))
    return rows.join(given, ["_name", "_place"]).withColumn("target", target).select(*files.columns, "target")


def organised(files: DataFrame, time: str = "shoot_time", place: str = "location") -> DataFrame:
    """``files`` with folder ``year/place``; files without a time or place go to folders of their own."""
    year = F.when(F.col(time).rlike("^[0-9]{4}"), F.substring(time, 1, 4)).otherwise("unknown-year")
    where = F.coalesce(F.nullif(folder_name(F.col(place)), F.lit("")), F.lit("unknown-place"))
    return files.withColumn("folder", F.concat_ws("/", year, where))


def bar_percents(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling to 8..100; 60 where all are equal, 8 for values that are no numbers."""
    scaled = 8 + 92 * (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(value.isNull() | F.isnan(value), F.lit(8.0)).otherwise(F.coalesce(scaled, F.lit(60.0)))
