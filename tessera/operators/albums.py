"""Albums, folders and categories: guarded inserts, partial updates, merges, batches with their outcome, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.merge import insert_or_ignore
from tessera.operators.numbering import numbered
from tessera.operators.text_index import like_any_case, parsed, says
from tessera.sources.shared import dealt_anew

# Fixed values of the application.
VIRTUAL_KINDS = ["archived", "hidden"]
NAME_CHARS, DESCRIPTION_CHARS, FOLDER_LEVELS = 100, 500, 3


def is_virtual(kind: Column) -> Column:
    return F.coalesce(kind.isin(*VIRTUAL_KINDS), F.lit(False))


def checked_state(state: str) -> str:
    """The state of a mark; ValueError for any but the two known ones."""
    if state not in VIRTUAL_KINDS:
        raise ValueError(f"unknown state {state!r}")
    return state


def album_problem(name: Column, path: Column, description: Column) -> Column:
    """What keeps an album from being created: name, name length, path or description length; null if nothing does."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    return (
        F.when(trimmed == "", "name")
        .when(F.char_length(trimmed) > NAME_CHARS, "name length")
        .when(F.trim(F.coalesce(path, F.lit(""))) == "", "path")
        .when(F.char_length(description) > DESCRIPTION_CHARS, "description length")
    )


def with_virtual_albums(albums: DataFrame, users: DataFrame) -> DataFrame:
    """``albums`` (user_id, kind, name) with one album of each virtual kind for every user of ``users`` (user_id) who lacks it."""
    wanted = users.select("user_id", F.explode(F.array(*map(F.lit, VIRTUAL_KINDS))).alias("kind")).withColumn("name", F.col("kind"))
    return insert_or_ignore(albums, wanted.select(*albums.columns), ["user_id", "kind"])


def partly_updated(old: DataFrame, changes: DataFrame, key: str, clearable: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``old`` with the given fields of ``changes``: null keeps the old value; an empty text clears a field of ``clearable``."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("new_key"), *(F.col(c).alias(f"new_{c}") for c in fields))
    joined = old.join(new, F.col(key) == F.col("new_key"), "left")

    def value(c: str) -> Column:
        given = F.coalesce(F.col(f"new_{c}"), F.col(c))
        return (F.when(F.col(f"new_{c}") == "", F.lit(None)).otherwise(given) if c in clearable else given).alias(c)

    return joined.select(*(value(c) if c in fields else F.col(c) for c in old.columns))


def batch_updated(old: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``old`` with ``column`` set for the rows whose key is in ``ids``."""
    chosen = ids.select(key).distinct().withColumn("chosen", F.lit(True))
    return old.join(chosen, key, "left").withColumn(column, F.when(F.col("chosen"), value).otherwise(F.col(column))).select(*old.columns)


def batch_outcome(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(requested, ok, failed) of a batch: an id fails if there is no such row. The failed ids are those of :func:`batch_failures`."""
    found = ids.select(key).join(old.select(key).distinct().withColumn("there", F.lit(1)), key, "left")
    return found.agg(F.count("*").alias("requested"), F.count("there").alias("ok"), F.count_if(F.col("there").isNull()).alias("failed"))


def batch_failures(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return ids.select(key).join(old.select(key), key, "left_anti")


def merged_albums(photos: DataFrame, merges: DataFrame, move: bool, at: str) -> tuple[DataFrame, DataFrame]:
    """(photos, provenance) after the albums of ``merges`` (source_id, target_id) went into others.

    Moving gives the photos the new album; recording leaves them and only notes the merge. A source that is its own
    target is no merge.
    """
    real = merges.where("source_id <> target_id")
    provenance = photos.groupBy(F.col("album_id").alias("source_id")).agg(F.count("*").alias("n_photos")).join(real, "source_id", "right")
    noted = provenance.select("target_id", "source_id", F.coalesce("n_photos", F.lit(0)).alias("n_photos"), F.lit(at).alias("merged_at"))
    if not move:
        return photos, noted
    moved = photos.join(dealt_anew(real, "target_id", "source_id"), F.col("album_id") == F.col("source_id"), "left")
    return moved.withColumn("album_id", F.coalesce("target_id", "album_id")).select(*photos.columns), noted


def created_folders(folders: DataFrame, requests: DataFrame) -> DataFrame:
    """(name, parent_id, level, sort_order, problem) of the folders asked for by ``requests`` (name, parent_id).

    A folder lies one level below its parent and comes last among its siblings; one without a parent is a root.
    Names are trimmed. Empty names, unknown parents and levels beyond FOLDER_LEVELS are problems, in this order, and such
    a folder has no level and takes no place.
    """
    parents = folders.select(F.col("id").alias("parent_id"), F.col("level").alias("above"))
    last = folders.groupBy(F.col("parent_id").alias("of")).agg(F.max("sort_order").alias("last"))
    rows = requests.join(parents, "parent_id", "left").join(dealt_anew(last, "last", "of"), F.col("of").eqNullSafe(F.col("parent_id")), "left")
    rows = rows.withColumn("name", F.regexp_replace(F.coalesce("name", F.lit("")), r"(?U)^\s+|\s+$", ""))
    problem = F.when(F.col("name") == "", "name").when(F.col("parent_id").isNotNull() & F.col("above").isNull(), "parent").when(F.col("above") >= FOLDER_LEVELS, "level")
    placed = numbered(rows.select("name", "parent_id", "above", "last", problem.alias("problem")), ["parent_id", "problem"], ["name"], "nth")
    fine = F.col("problem").isNull()
    level = F.when(fine, F.coalesce("above", F.lit(0)) + 1)
    return placed.select("name", "parent_id", level.alias("level"), F.when(fine, F.coalesce("last", F.lit(-1)) + 1 + F.col("nth")).alias("sort_order"), "problem")


def without_folder(folders: DataFrame, albums: DataFrame, gone: int) -> tuple[DataFrame, DataFrame]:
    """(folders, albums) without one folder: its children become roots of level 1, its albums lie in none."""
    inside = F.coalesce(F.col("parent_id") == gone, F.lit(False))
    left = folders.where(F.col("id") != gone).withColumn("level", F.when(inside, 1).otherwise(F.col("level"))).withColumn("parent_id", F.when(~inside, F.col("parent_id")))
    return left, albums.withColumn("folder_id", F.when(F.col("folder_id") != gone, F.col("folder_id")))


def listed(rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """(group, name): the values of each group in order as a list, such as the tags or merge sources of an album, which are few."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(group).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def in_order(rows: DataFrame, keys: list[Column], key: str) -> DataFrame:
    """``rows`` with place by ``keys``, then by ``key``; nulls first, so an expression says where they go."""
    named = rows.select("*", *(k.alias(f"order_{i}") for i, k in enumerate(keys)))
    return numbered(named, [], [*(f"order_{i}" for i in range(len(keys))), key]).select(*rows.columns, "place")


def category_texts(keywords: Column, excludes: Column) -> Column:
    """Keywords, then excludes, trimmed, without empty ones and repetitions."""
    both = F.concat(F.coalesce(keywords, F.array().cast("array<string>")), F.coalesce(excludes, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(both, lambda t: F.trim(t)), lambda t: t != ""))


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code itself."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), code)


def reused_stats(files: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """(key, file_count, bytes, reused): cached rows stay while the number of files is the same."""
    now = files.groupBy(key).agg(F.count("*").alias("file_count"), F.sum("size").alias("now_bytes"))
    old = cached.select(F.col(key).alias("old_key"), F.col("file_count").alias("old_count"), F.col("bytes").alias("old_bytes"))
    same = F.coalesce(F.col("old_count") == F.col("file_count"), F.lit(False))
    return now.join(old, F.col(key) == F.col("old_key"), "left").select(key, "file_count", F.when(same, F.col("old_bytes")).otherwise(F.col("now_bytes")).alias("bytes"), same.alias("reused"))


def repaired_index(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """The index, derived anew from ``rows`` where their numbers differ."""
    return index if rows.count() == index.count() else rows.select(*index.columns)


def sanitised_groups(items: DataFrame, order: str = "place") -> DataFrame:
    """(group_id, keep_path, items, deletable, reclaimable, collapsed) of duplicate groups that still let something go.

    ``items`` has group_id, path, dir, size, keep_path and its place in the report. Of equal paths (any case) the first
    counts. A keeper that is not among the items gives way to the first item. What lies in the keeper's folder stays.
    """
    raw = items.groupBy("group_id").agg(F.count("*").alias("raw"), F.max("keep_path").alias("wanted"))
    single = items.groupBy("group_id", F.lower("path").alias("low")).agg(F.min(F.struct(F.col(order).alias("at"), "path", "dir", "size")).alias("m")).select("group_id", "m.*")
    picks = single.join(dealt_anew(raw, "wanted", "group_id"), "group_id")
    keep = picks.groupBy("group_id").agg(
        F.count("*").alias("items"), F.max("raw").alias("raw"),
        F.coalesce(F.min(F.when(F.col("path") == F.col("wanted"), F.struct("at", "path", "dir"))), F.min(F.struct("at", "path", "dir"))).alias("keep"),
    )
    gone = single.join(dealt_anew(keep, "items", "group_id"), "group_id").where((F.col("path") != F.col("keep.path")) & (F.lower("dir") != F.lower("keep.dir")))
    return gone.groupBy("group_id").agg(
        F.max("keep.path").alias("keep_path"), F.max("items").alias("items"), F.count("*").alias("deletable"), F.sum("size").alias("reclaimable"),
        F.max(F.col("raw") - F.col("items")).alias("collapsed"),
    )


def rekeyed(rows: DataFrame, key: str, old: Column, new: Column) -> DataFrame:
    """``rows`` whose key is that of an ``old`` rule get the ``new`` one; of rows that then share a key the one that had it stays."""
    due = F.col(key).eqNullSafe(old)
    moved = rows.select(F.when(due, new).otherwise(F.col(key)).alias("fresh"), F.when(due, 1).otherwise(0).alias("late"), F.struct(*rows.columns).alias("row"))
    first = moved.groupBy("fresh").agg(F.min(F.struct("late", "row")).alias("best"))
    return first.select("fresh", "best.row.*").withColumn(key, F.col("fresh")).select(*rows.columns)


def relabelled(rows: DataFrame, keys: list[str], column: str, old: list[str], new: str) -> DataFrame:
    """``column`` set to ``new`` where it is one of ``old``, one after the other: of rows that then share ``keys`` the one renamed last stays."""
    if new in old:
        return rows
    turn = F.coalesce(F.array_position(F.array(*map(F.lit, old)), F.col(column)), F.lit(0)) if old else F.lit(0)
    rest = [c for c in rows.columns if c not in [*keys, column]]
    named = rows.select(*keys, F.when(turn > 0, F.lit(new)).otherwise(F.col(column)).alias(column), F.struct(turn.alias("turn"), *rest).alias("row"))
    return named.groupBy(*keys, column).agg(F.max("row").alias("row")).select(*keys, column, *(f"row.{c}" for c in rest)).select(*rows.columns)


def searched(rows: DataFrame, keyword: str, columns: list[str]) -> DataFrame:
    """Rows with one of the words of a keyword, the last of which may be a beginning, and how many of them as hits; a keyword that is no search for words finds rows LIKE it."""
    text, asked = F.concat_ws(" ", *columns), parsed(keyword)
    if asked is None:
        return rows.where(like_any_case(text, keyword)).withColumn("hits", F.lit(0))
    hits = sum((says(text, [one]).cast("int") for one in asked), F.lit(0))
    return rows.withColumn("hits", hits).where("hits > 0")
