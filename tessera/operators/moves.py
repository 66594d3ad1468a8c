"""A log of moved paths, resolved once and applied to all tables that hold paths."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import dir_name
from tessera.operators.graph import forest_roots
from tessera.sources.shared import Scratch, dealt_anew, stage


class Held(NamedTuple):
    """How a table holds paths: its rows, the path, and the columns that follow a move, if it has them.

    ``key`` are the columns that may occur once, the path among them; None if paths may repeat.
    """

    rows: DataFrame
    path: str = "path"
    folder: str | None = None
    album: str | None = None
    key: tuple[str, ...] | None = None


def resolved_moves(moves: DataFrame) -> DataFrame:
    """(old_path, new_path, album_id, seq): where what lay at old_path before all ``moves`` (seq, old_path, new_path, album_id) lies after them, with the album and number of its last move.

    Moves take place in order of seq, each with all that lies at its old path by then. The next move of what a move
    brings is the first later one from its new path, so moves form a forest, and pointer doubling finds the last one of
    each chain in as many rounds as the logarithm of its length. A move between equal paths and one with a null are none;
    of several moves of one seq the least counts.
    """
    logged = moves.where("seq is not null and old_path <> new_path").groupBy("seq").agg(F.min(F.struct("old_path", "new_path", "album_id")).alias("m"))
    logged = stage(logged.select("seq", "m.*"), "moves")
    # at each path the arrivals and departures in order; an arrival leaves with the next departure
    events = logged.select(F.col("new_path").alias("path"), "seq", F.lit(None).cast("long").alias("leaves")).union(logged.select("old_path", "seq", F.col("seq").cast("long")))
    # latest first, since Spark reckons a frame up to the row before it in one pass, one of all rows behind it anew for each row
    later = Window.partitionBy("path").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    following = events.withColumn("next", F.last("leaves", ignorenulls=True).over(later)).where("leaves is null and next is not null")
    with Scratch(moves.sparkSession) as scratch:
        last = stage(forest_roots(following.select(F.col("seq").cast("long").alias("node"), F.col("next").alias("parent")), scratch), "last")
    first = logged.groupBy("old_path").agg(F.min("seq").cast("long").alias("first"))
    ended = first.join(last.select(F.col("node").alias("first"), "root"), "first", "left").select("old_path", F.coalesce("root", "first").alias("seq"))
    return ended.join(logged.select(F.col("seq").cast("long").alias("seq"), "new_path", "album_id"), "seq").select("old_path", "new_path", "album_id", "seq")


def _moved(held: Held, resolved: DataFrame) -> DataFrame:
    known = resolved.select(F.col("old_path").alias(held.path), F.col("new_path").alias("to_path"), F.col("album_id").alias("to_album"), F.col("seq").alias("moved_seq"))
    rows = held.rows.join(dealt_anew(known, "to_path", held.path), held.path, "left")
    changed: dict[str, Column] = {held.path: F.coalesce("to_path", held.path)}
    if held.folder:
        changed[held.folder] = F.when(F.col("to_path").isNotNull(), dir_name(F.col("to_path"))).otherwise(F.col(held.folder))
    if held.album:
        changed[held.album] = F.when(F.col("to_path").isNotNull(), F.col("to_album")).otherwise(F.col(held.album))
    rows = rows.withColumns(changed)
    if held.key:
        rest = [c for c in held.rows.columns if c not in held.key]
        best = rows.groupBy(*held.key).agg(F.max(F.struct(F.coalesce("moved_seq", F.lit(-1)).alias("at"), *rest)).alias("row"))
        rows = best.select(*held.key, *(F.col(f"row.{c}").alias(c) for c in rest))
    return rows.select(*held.rows.columns)


def moved_everywhere(tables: dict[str, Held], moves: DataFrame) -> dict[str, DataFrame]:
    """All ``tables`` after the same log of moves; where a path may occur once, the row that moved last keeps it, and an unmoved one gives way."""
    resolved = stage(resolved_moves(moves), "resolved")
    return {name: _moved(held, resolved) for name, held in tables.items()}


def deleted_everywhere(tables: dict[str, Held], gone: DataFrame) -> dict[str, DataFrame]:
    """All ``tables`` without the rows of the paths ``gone`` (path)."""
    listed = gone.select("path").distinct()
    return {name: held.rows.join(listed.withColumnRenamed("path", held.path), held.path, "left_anti").select(*held.rows.columns) for name, held in tables.items()}
