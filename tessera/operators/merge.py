"""Merges of a table with a batch of changes, as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_owned(old: DataFrame, new: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """Merge ``new`` into ``old`` by key, group of fields by group.

    ``groups`` maps a flag column of ``new`` to the fields it owns: where the
    flag is set the new values win, nulls included; elsewhere a new value wins
    only if there is one. One full outer join on the key does it.
    """
    fields = [c for cols in groups.values() for c in cols]
    n = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_n_{c}") for c in fields), *(F.col(f) for f in groups))
    joined = old.join(n, F.col(key) == F.col("_key"), "full_outer")
    merged = []
    for flag, cols in groups.items():
        for c in cols:
            merged.append(F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(f"_n_{c}")).otherwise(F.coalesce(F.col(f"_n_{c}"), F.col(c))).alias(c))
    return joined.select(F.coalesce(F.col(key), F.col("_key")).alias(key), *merged)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` with unknown keys are added; of several with one key the least row is."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_slice(old: DataFrame, new: DataFrame, column: str, value: object) -> DataFrame:
    """The rows with ``column`` equal to ``value`` are exchanged for ``new``."""
    return old.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def delete_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def move_path(rows: DataFrame, moves: DataFrame, column: str = "path") -> DataFrame:
    """Paths renamed by ``moves`` (old_path, new_path)."""
    joined = rows.join(moves, rows[column] == moves["old_path"], "left")
    return joined.withColumn(column, F.coalesce("new_path", column)).select(*rows.columns)


def edit_array(column: str, add: str | None = None, remove: str | None = None):
    """(array, size) columns after removing and adding a member; an empty array becomes null."""
    values = F.coalesce(F.col(column), F.array().cast("array<string>"))
    if remove is not None:
        values = F.array_remove(values, remove)
    if add is not None:
        values = F.array_union(values, F.array(F.lit(add)))
    return F.when(F.size(values) > 0, values), F.size(values)


def renumbered(rows: DataFrame, parent: str, order: str, moved: object, index: int, key: str) -> DataFrame:
    """``rows`` with ``order`` renumbered from 0 among siblings after ``moved`` went to place ``index``.

    The moved row takes part between its new neighbours: half a place before
    the row that held the index.
    """
    others = rows.withColumn("_last", F.col(key) == F.lit(moved)).withColumn("_n", F.row_number().over(Window.partitionBy(parent, "_last").orderBy(order, key)) - 1)
    count = F.count("*").over(Window.partitionBy(parent)) - 1
    place = F.when(F.col("_last"), F.least(F.lit(index), count) - 0.5).otherwise(F.col("_n"))
    return others.withColumn(order, F.row_number().over(Window.partitionBy(parent).orderBy(place, key)) - 1).drop("_last", "_n")
