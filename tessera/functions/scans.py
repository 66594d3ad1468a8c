"""Scalar rules of scans: reports, durations, dates, records without recognition, vectors as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def skipped(total: Column, processed: Column) -> Column:
    return F.greatest(F.lit(0), total - processed)


def merged_report(written: Column, other_written: Column, failed: Column, other_failed: Column) -> Column:
    return F.struct(F.greatest(written, other_written).alias("written"), (failed + other_failed).alias("failed"))


def duration(ms: Column) -> Column:
    """Milliseconds with two digits below ten, one below a hundred, none above; - for no number."""
    value = ms.cast("double")
    none = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    shown = lambda digits: F.format_string(f"%.{digits}f", F.bround(value, digits))  # noqa: E731  halves to the even digit
    return F.when(none, "-").when(value >= 100, shown(0)).when(value >= 10, shown(1)).otherwise(shown(2))


def phase_balance(spans: DataFrame, run: str, ms: str, wall: str) -> DataFrame:
    """(run, total, rest, overlap): the phases of each run against its wall time; neither is negative."""
    sums = spans.groupBy(run).agg(F.sum(ms).alias("total"), F.max(wall).alias("wall"))
    return sums.select(run, "total", F.greatest(F.lit(0.0), F.col("wall") - F.col("total")).alias("rest"), F.greatest(F.lit(0.0), F.col("total") - F.col("wall")).alias("overlap"))


# The words of a line of phases, and the milliseconds from which an overlap is told.
WHOLE, NO_PHASES, OVERLAP, REST = "总 ", "无阶段记录", "阶段重叠(并发) ~", "未计入(调度/序列化/等待) "
LEAST_OVERLAP = 0.5


def phase_lines(spans: DataFrame, run: str, order: str, name: str, ms: str, note: str, walls: DataFrame, wall: str) -> DataFrame:
    """(run, line) for each run of ``walls``: the wall time, its phases in order with their notes, and what is left.

    If the phases add up to over half a millisecond more than the wall time they overlapped, and that is told; else the rest
    is. A run without phases says so. The phases of a run are few.
    """
    shown = F.concat(F.col(name), F.lit(" "), duration(F.col(ms)), F.when(F.coalesce(F.col(note), F.lit("")) == "", "").otherwise(F.concat(F.lit("("), F.col(note), F.lit(")"))))
    parts = spans.groupBy(run).agg(F.sum(ms).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), shown.alias("part")))), lambda x: x["part"]), " · ").alias("parts"))
    over = F.col("total") - F.col(wall)
    tail = F.when(over > LEAST_OVERLAP, F.concat(F.lit(OVERLAP), duration(over))).otherwise(F.concat(F.lit(REST), duration(F.greatest(F.lit(0.0), -over))))
    told = F.when(F.col("parts").isNull(), F.concat(F.lit(WHOLE), duration(F.col(wall)), F.lit("ms | " + NO_PHASES))).otherwise(F.concat(F.lit(WHOLE), duration(F.col(wall)), F.lit("ms | "), F.col("parts"), F.lit(" | "), tail))
    return walls.join(parts, run, "left").select(run, told.alias("line"))


def iso_date(raw: Column) -> Column:
    """The date part of a camera time with dashes; null unless all its places are digits."""
    t = F.regexp_replace(F.trim(raw), '^"+|"+$', "")
    return F.when(t.rlike(r"^[0-9]{4}.[0-9]{2}.[0-9]{2}"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 6, 2), F.substring(t, 9, 2)))


def unix_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since 1970 of a civil time in UTC; null for a date that doesn't exist."""
    days = F.datediff(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date"))
    return F.when(hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60), days.cast("long") * 86400 + hour * 3600 + minute * 60 + second)


def civil_time(seconds: Column) -> Column:
    """(year, month, day, hour, minute, second) in UTC of seconds since 1970, also before it."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    parts = [F.year(date), F.month(date), F.dayofmonth(date), F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60]
    return F.struct(*(p.cast("int").alias(n) for p, n in zip(parts, ("year", "month", "day", "hour", "minute", "second"))))


def content_text(category: Column, sub_category: Column, label: Column, top: Column, persons: Column) -> Column:
    """The searchable text of a photo in lower case: category, sub-category, label, top labels and person ids without empty ones."""
    named = F.array(*(F.coalesce(c, F.lit("")) for c in (category, sub_category, label)))
    tops = F.coalesce(top, F.array().cast("array<string>"))
    return F.lower(F.array_join(F.concat(F.filter(F.concat(named, tops), lambda t: t != ""), F.coalesce(persons, F.array().cast("array<string>"))), " "))


def resolved_place(place: Column, found: Column) -> Column:
    """The place written in a photo, or else the one its position lies in."""
    return F.coalesce(F.nullif(F.trim(place), F.lit("")), found)


def plain_records(exif: DataFrame, tones: DataFrame) -> DataFrame:
    """(path, shoot_time, location, tone, category, owns_ai, owns_exif): rows without recognition; of either table if the other lacks the path."""
    joined = exif.select("path", "shoot_time", "location", F.lit(True).alias("has")).join(tones.select("path", "tone"), "path", "full_outer")
    return joined.select("path", "shoot_time", "location", "tone", F.lit(None).cast("string").alias("category"), F.lit(False).alias("owns_ai"), F.coalesce("has", F.lit(False)).alias("owns_exif"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Brightness 0 to 255 by the integer weights of BT.601."""
    return F.floor((red * 299 + green * 587 + blue * 114) / 1000)


def similarity_threshold(asked: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.7), asked)).cast("float")


def badge_lane(kind: Column, image: Column, description: Column) -> Column:
    """The score of the lane that suits the kind of query, else of the other one."""
    return F.when(kind == "object", F.coalesce(image, description)).otherwise(F.coalesce(description, image))


@arrow_udf(T.ArrayType(T.FloatType()))
def vector_of_bytes(blobs: pa.Array) -> pa.Array:
    """Little-endian single-precision numbers; bytes beyond the last whole number don't count."""
    blobs = blobs.cast(pa.large_binary())
    known = blobs.fill_null(b"")
    whole = pc.multiply(pc.divide(pc.binary_length(known), 4), 4)
    if not pc.all(pc.equal(whole, pc.binary_length(known))).as_py():  # rare: cut the odd ones
        known = pa.array([b[: len(b) // 4 * 4] for b in known.to_pylist()], pa.large_binary())
    bounds = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
    numbers = np.frombuffer(known.buffers()[2] or b"", "<f4", int(bounds[-1] - bounds[0]) // 4, int(bounds[0])) if bounds[-1] > bounds[0] else np.zeros(0, "<f4")
    return pa.ListArray.from_arrays(pa.array((bounds - bounds[0]) // 4, pa.int32()), pa.array(numbers), mask=blobs.is_null())


@arrow_udf(T.BinaryType())
def bytes_of_vector(vectors: pa.Array) -> pa.Array:
    """The numbers of each vector one after the other; a null in a vector counts as 0."""
    numbers = vectors.flatten().cast(pa.float32()).fill_null(0.0).to_numpy().astype("<f4")
    bounds = np.concatenate([[0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy())]).astype(np.int32) * 4
    missing = vectors.is_null()
    valid = None if not missing.null_count and not pc.any(missing).as_py() else pa.py_buffer(np.packbits(~missing.to_numpy(zero_copy_only=False), bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(vectors), [valid, pa.py_buffer(bounds.tobytes()), pa.py_buffer(numbers.tobytes())])
