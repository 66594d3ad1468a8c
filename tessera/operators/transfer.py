"""Transfer of the look of one set of pixels to another: by moments, by ranks, in Lab."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the sRGB and CIE Lab definitions (D65).
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
DELTA = 6.0 / 29.0
#: Keeps a constant channel from dividing by zero.
EPSILON = 1e-6
LEVELS = 256


def lab(r: Column, g: Column, b: Column) -> Column:
    """Struct (l, a, b) of 8-bit sRGB values."""

    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    def curve(t: Column) -> Column:
        return F.when(t > DELTA**3, F.cbrt(t)).otherwise(t / (3 * DELTA * DELTA) + 4.0 / 29.0)

    channels = [linear(c) for c in (r, g, b)]
    x, y, z = (curve(sum((w * c for w, c in zip(row[1:], channels[1:])), row[0] * channels[0]) / white) for row, white in zip(TO_XYZ, WHITE))
    return F.struct((116.0 * y - 16.0).alias("l"), (500.0 * (x - y)).alias("a"), (200.0 * (y - z)).alias("b"))


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, in one aggregation; (0, 0) for an empty table."""
    row = df.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_pop))).first()
    return {c: (row[f"avg_{c}"] or 0.0, row[f"stddev_pop_{c}"] or 0.0) for c in columns}


def matched_moments(source: DataFrame, reference: DataFrame, columns: list[str], weights: list[float]) -> DataFrame:
    """``source`` with each column moved to the mean and deviation it has in ``reference``, by its weight from 0 to 1."""
    own, wanted = moments(source, columns), moments(reference, columns)
    moved = {}
    for c, weight in zip(columns, weights):
        (m, s), (wm, ws) = own[c], wanted[c]
        target = (F.col(c) - m) * ((ws + EPSILON) / (s + EPSILON)) + wm
        moved[c] = F.col(c) * (1 - weight) + target * weight
    return source.withColumns(moved)


def _level_at(uppers: list[tuple[int, int]]) -> Column:
    """The level of the first of ``uppers`` (upto, level) that exceeds _place, by halving: a row is compared as often as the logarithm of their number."""
    if len(uppers) == 1:
        return F.lit(uppers[0][1])
    middle = len(uppers) // 2
    return F.when(F.col("_place") < uppers[middle - 1][0], _level_at(uppers[:middle])).otherwise(_level_at(uppers[middle:]))


def matched_ranks(source: DataFrame, reference: DataFrame, key: str, value: str, block: int = 1 << 16) -> DataFrame:
    """``source`` with ``matched``: the reference value at the same rank; ``value`` is an 8-bit level, ties go by the unique ``key``.

    Ranks come from counts: those of lower levels (LEVELS numbers), those of
    earlier blocks of keys, and the row number within a block, so no level is
    sorted as a whole. A reference without rows gives nulls.
    """
    wanted = sorted((r[value], r["n"]) for r in reference.groupBy(value).agg(F.count("*").alias("n")).collect())
    own = sorted((r[value], r["n"]) for r in source.groupBy(value).agg(F.count("*").alias("n")).collect())
    assert len(wanted) <= LEVELS and len(own) <= LEVELS, "levels must be 8-bit"
    n, m = sum(c for _, c in own), sum(c for _, c in wanted)
    if not n or not m:
        return source.withColumn("matched", F.lit(None).cast(source.schema[value].dataType))
    lower = source.sparkSession.createDataFrame([(v, upto - c) for (v, c), upto in zip(own, accumulate(c for _, c in own))], "_v long, _lower long")
    uppers = [(upto, v) for (v, _), upto in zip(wanted, accumulate(c for _, c in wanted))]
    rows = source.withColumn("_block", F.floor(F.col(key) / block))
    earlier = Window.partitionBy(value).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(value, "_block").agg(F.count("*").alias("_n")).select(value, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    offsets = offsets.join(F.broadcast(lower), F.col(value) == F.col("_v")).select(F.col(value).alias("_level"), F.col("_block").alias("_of"), (F.col("_offset") + F.col("_lower")).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(value, "_block").orderBy(key))
    rank = F.col("_offset") + F.col("_at") - 1
    place = F.least(F.lit(m - 1), F.floor(rank / float(max(n - 1, 1)) * (m - 1)))
    return (
        rows.withColumn("_at", within)
        .join(offsets, (F.col(value) == F.col("_level")) & (F.col("_block") == F.col("_of")))
        .withColumn("_place", place)
        .withColumn("matched", _level_at(uppers))
        .drop("_block", "_at", "_offset", "_place", "_level", "_of")
    )
