"""Persons and their faces: gates, overrides, moves, names, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import normalised
from tessera.operators.means import element_means
from tessera.operators.merge import insert_or_ignore, upsert
from tessera.operators.prefixes import owners_any_case
from tessera.sources.shared import dealt_anew

# Fixed values of the face gate: bounds of ratios, degrees and pixels.
ASPECT, EYE_SPAN, NOSE_DY, MOUTH_DY = (0.62, 1.60), (0.28, 0.58), (0.12, 1.00), (0.10, 1.60)
YAW, ROLL, LEAST_SIDE = 0.50, 32.0, 48
MARGINAL_YAW, MARGINAL_ROLL, MARGINAL_SIDE = 0.35, 25.0, 64


def face_verdict(box: Column, points: Column) -> Column:
    """reject, marginal or ok, from a box (x1, y1, x2, y2) and five points (x, y): eyes, nose, corners of the mouth."""
    width, height = (F.greatest(box[hi] - box[lo], F.lit(1)) for lo, hi in (("x1", "x2"), ("y1", "y2")))
    left, right, nose, mouth_a, mouth_b = (F.get(points, F.lit(i)) for i in range(5))
    apart = F.hypot(right["x"] - left["x"], right["y"] - left["y"])
    eyes_y = (left["y"] + right["y"]) / 2
    yaw = F.abs(nose["x"] - (left["x"] + right["x"]) / 2) / apart
    roll = F.abs(F.degrees(F.atan2(right["y"] - left["y"], right["x"] - left["x"])))
    side = F.least(width, height)
    ratios = [(width / height, ASPECT), (apart / width, EYE_SPAN), ((nose["y"] - eyes_y) / apart, NOSE_DY), (((mouth_a["y"] + mouth_b["y"]) / 2 - nose["y"]) / apart, MOUTH_DY)]
    fits = (side >= LEAST_SIDE) & (yaw <= YAW) & (roll <= ROLL)
    for value, (low, high) in ratios:
        fits = fits & value.between(low, high)
    marginal = (yaw > MARGINAL_YAW) | (roll > MARGINAL_ROLL) | (side < MARGINAL_SIDE)
    return F.when(apart <= 1e-6, "reject").when(~fits, "reject").when(marginal, "marginal").otherwise("ok")


def cover_rectangle(width: Column, height: Column, box: Column, ratio: float, expand: float) -> Column:
    """(x, y, w, h) of a cover of the given ratio around a face, within the image; the face sits a little above the middle."""
    face = F.greatest(F.abs(box["x2"] - box["x1"]), F.abs(box["y2"] - box["y1"]), F.lit(1.0))
    wide = face * (1 + 2 * expand)
    tall = wide / max(ratio, 0.01)
    shrink = F.least(F.lit(1.0), width / wide, height / tall)
    w, h = wide * shrink, tall * shrink

    def within(middle: Column, size: Column, whole: Column) -> Column:
        return F.round(F.least(F.greatest(middle - size / 2, F.lit(0.0)), F.greatest(whole - size, F.lit(0.0)))).cast("int")

    x, y = within((box["x1"] + box["x2"]) / 2, w, width), within((box["y1"] + box["y2"]) / 2 - h * 0.06, h, height)
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.round(w), F.lit(1.0)).cast("int").alias("w"), F.greatest(F.round(h), F.lit(1.0)).cast("int").alias("h"))


def persons_below(faces: DataFrame, persons: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, person_id, name, photos): the known persons seen below each root of ``roots`` (id, root) and in how many photos.

    Case, kind of separator and separators at the end of a root do not count; faces of unknown persons are left out.
    """
    below = owners_any_case(faces.select("person_id", "path"), roots)
    counts = below.groupBy("root_id", "person_id").agg(F.countDistinct("path").alias("photos"))
    return counts.join(persons.select("person_id", "name"), "person_id").select("root_id", "person_id", "name", "photos")


def with_signature(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """(person_id, signature): number and last id of a person's faces; null without any."""
    seen = faces.groupBy("person_id").agg(F.concat_ws(":", F.count("*"), F.max("face_id")).alias("signature"))
    return persons.select("person_id").join(seen, "person_id", "left")


def names_of(ids: Column, names: Column) -> Column:
    """Names of a list of ids by a map, distinct in order; ids without a name are left out."""
    return F.array_distinct(F.filter(F.transform(ids, lambda i: F.try_element_at(names, i)), lambda n: n.isNotNull() & (n != "")))


def with_overrides(faces: DataFrame, overrides: DataFrame) -> DataFrame:
    """``faces`` with the person that a user gave to (path, box), else the one found."""
    given = overrides.select("path", "box", F.col("person_id").alias("given"))
    return faces.join(given, ["path", "box"], "left").withColumn("person_id", F.coalesce("given", "person_id")).select(*faces.columns)


def set_overrides(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new.select(*old.columns), ["path", "box"])


def moved_faces(faces: DataFrame, overrides: DataFrame, source: str, target: str | None, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, overrides) after the faces of ``source`` on ``paths`` went to ``target``, or away if it is None; a move is an override."""
    listed = paths.select("path").distinct().withColumn("listed", F.lit(True))
    marked = faces.join(dealt_anew(listed, "listed", "path"), "path", "left").withColumn("moves", F.coalesce(F.col("listed") & (F.col("person_id") == source), F.lit(False)))
    if target is None:
        return marked.where("not moves").select(*faces.columns), overrides
    noted = set_overrides(overrides, marked.where("moves").select("path", "box", F.lit(target).alias("person_id")).distinct())
    return marked.withColumn("person_id", F.when(F.col("moves"), F.lit(target)).otherwise(F.col("person_id"))).select(*faces.columns), noted


def person_centroids(faces: DataFrame) -> DataFrame:
    """(person_id, faces, centroid): normalised means, added up element by element."""
    flat = element_means(faces, "person_id").withColumnsRenamed({"pos": "at", "rows": "n"})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda p: p["m"])
    return flat.groupBy("person_id").agg(F.max("n").alias("faces"), normalised(ordered).alias("centroid"))


def rebuild_queue(queue: DataFrame, photos: DataFrame, now: int) -> DataFrame:
    """``queue`` (path, added_at) with the photos that show persons, by a list of ids or a number."""
    shown = (F.col("person_ids").isNotNull() & ~F.col("person_ids").isin("", "[]")) | (F.col("person_count") > 0)
    return insert_or_ignore(queue, photos.where(shown).select("path", F.lit(now).cast("long").alias("added_at")).distinct(), ["path"])


def reset_counts(faces: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, faces, persons): what a reset removes, and the empty tables after it."""
    return faces.agg(F.count("*").alias("faces")).crossJoin(persons.agg(F.count("*").alias("persons"))), faces.limit(0), persons.limit(0)


def detections(boxes: DataFrame, persons: list[int], vehicles: list[int]) -> DataFrame:
    """(image, persons, vehicles, max_conf, max_area) of boxes (image, kind, conf, x1, y1, x2, y2, width, height)."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("width") * F.col("height"))
    person = F.col("kind").isin(*persons)
    return boxes.groupBy("image").agg(
        F.count_if(person).alias("persons"), F.count_if(F.col("kind").isin(*vehicles)).alias("vehicles"),
        F.coalesce(F.max(F.when(person, F.col("conf"))), F.lit(0.0)).alias("max_conf"), F.coalesce(F.max(F.when(person, area)), F.lit(0.0)).alias("max_area"),
    )


def reading_order(box: Column) -> Column:
    """Sort key of text boxes: the row, in heights of 0.8 of the box and of 12 at least, halves to the even one, then x."""
    line = F.greatest(F.lit(12.0), (box["y2"] - box["y1"]) * 0.8)
    return F.struct(F.bround(box["y1"] / line).alias("row"), box["x1"].alias("x"))
