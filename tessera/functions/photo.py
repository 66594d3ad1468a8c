"""Formatting and small arithmetic on photo metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(v: Column) -> Column:
    return v == F.round(v)


def format_focal(v: Column) -> Column:
    return F.when(_whole(v), F.format_string("%.0fmm", v)).otherwise(F.format_string("%.1fmm", v))


def format_aperture(v: Column) -> Column:
    return F.format_string("f/%.1f", v)


def format_shutter(v: Column) -> Column:
    return (
        F.when((v >= 1) & _whole(v), F.format_string("%.0fs", v))
        .when(v >= 1, F.format_string("%.1fs", v))
        .when(v > 0, F.format_string("1/%.0fs", F.round(1 / v)))
    )


def format_shoot_time(raw: Column) -> Column:
    """Camera time text with dashes in the date part; quotes around it go."""
    t = F.regexp_replace(F.trim(raw), '^"+|"+$', "")
    long = F.concat(F.replace(F.substring(t, 1, 10), F.lit(":"), F.lit("-")), F.lit(" "), F.substring(t, 12, 8))
    return F.when(F.char_length(t) >= 19, long).otherwise(F.replace(t, F.lit(":"), F.lit("-")))


def gps_local_time(stamp: Column, hours: int = 8) -> Column:
    """A GPS time, which is UTC, in the fixed local offset."""
    return stamp + F.make_interval(hours=F.lit(hours))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, reference: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(reference).isin("S", "W"), -value).otherwise(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def tone_class(luma: Column) -> Column:
    return F.when(luma < 85, "low").when(luma > 170, "high").when(luma.isNotNull(), "mid")


def coverage(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(part, whole))))


def format_bytes(n: Column) -> Column:
    k = n / 1024.0
    return (
        F.when(n.isNull() | (n <= 0), "0 KB")
        .when(k >= 1024 * 1024, F.format_string("%.1f GB", k / 1024 / 1024))
        .when(k >= 1024, F.format_string("%.1f MB", k / 1024))
        .otherwise(F.format_string("%.0f KB", F.round(k)))
    )


def format_bytes_log(n: Column) -> Column:
    k = 1024.0
    return (
        F.when(n >= k * k * k, F.format_string("%.2fGB", n / (k * k * k)))
        .when(n >= k * k, F.format_string("%.1fMB", n / (k * k)))
        .when(n >= k, F.format_string("%.0fKB", n / k))
        .otherwise(F.concat(n.cast("string"), F.lit("B")))
    )


def format_ms(ms: Column) -> Column:
    return (
        F.when(ms.isNull() | F.isnan(ms), "-")
        .when(ms >= 100, F.format_string("%.0f", ms))
        .when(ms >= 10, F.format_string("%.1f", ms))
        .otherwise(F.format_string("%.2f", ms))
    )


def saved_percent(before: Column, after: Column) -> Column:
    pct = F.round((1 - F.try_divide(after, before)) * 100).cast("int")
    return F.when(before.isNull() | (before <= 0), "").when(pct > 0, F.concat(F.lit("体积减少 "), pct.cast("string"), F.lit("%"))).otherwise("体积未减少")


def match_score(rel: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(rel, F.lit(0.0)))) * 1000).cast("int")


def parse_aspect(text: Column) -> Column:
    """``w:h`` as a struct of two positive numbers, null otherwise."""
    parts = F.split(text, ":")
    w, h = F.trim(F.get(parts, F.lit(0))).try_cast("int"), F.trim(F.get(parts, F.lit(1))).try_cast("int")
    return F.when((F.size(parts) == 2) & (w > 0) & (h > 0), F.struct(w.alias("w"), h.alias("h")))


def crop_rectangle(w: Column, h: Column, aw: Column, ah: Column) -> Column:
    """Centred rectangle of the wanted aspect; null where nothing is to be cut."""
    lhs, rhs = w.cast("long") * ah, h.cast("long") * aw
    cw = F.greatest(F.lit(1), F.floor(h.cast("long") * aw / ah)).cast("int")
    ch = F.greatest(F.lit(1), F.floor(w.cast("long") * ah / aw)).cast("int")

    def box(x: Column, y: Column, bw: Column, bh: Column) -> Column:
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), bw.cast("int").alias("w"), bh.cast("int").alias("h"))

    return F.when(lhs > rhs, box(F.floor((w - cw) / 2), F.lit(0), cw, h)).when(lhs < rhs, box(F.lit(0), F.floor((h - ch) / 2), w, ch))


def parse_bbox(raw: Column) -> Column:
    """The first four integers of a text as a box; null if fewer or without area."""
    v = F.transform(F.regexp_extract_all(raw, F.lit(r"-?[0-9]+"), F.lit(0)), lambda x: x.try_cast("long"))
    x1, y1, x2, y2 = (F.get(v, F.lit(i)) for i in range(4))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


# Thresholds of the rule cascade (fixed values).
SCREEN_TOLERANCE, SCREEN_MIN_SIDE = 0.06, 600
STREET_PERSONS, STREET_MAX_AREA, PORTRAIT_AREA, GROUP_AREA = 3, 0.20, 0.30, 0.10
HEAVY_VEHICLES, HEAVY_PERSON_AREA, NIGHT_LUMA, TEXT_AREA = 4, 0.03, 45, 0.12


def near_screen_ratio(w: Column, h: Column, aspects: list[tuple[int, int]]) -> Column:
    ratio_of = w / F.nullif(h, F.lit(0))
    tests = [F.abs(ratio_of - a / b) / (a / b) < SCREEN_TOLERANCE for a, b in aspects]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return F.coalesce((w > 0) & (h > 0) & hit, F.lit(False))


def person_verdict(count: Column, area: Column, vehicles: Column) -> Column:
    heavy = (vehicles >= HEAVY_VEHICLES) & (area < HEAVY_PERSON_AREA)
    return (
        F.when(F.coalesce(count, F.lit(0)) <= 0, F.lit(None).cast("string"))
        .when((count >= STREET_PERSONS) & (area < STREET_MAX_AREA) & ~heavy, "street")
        .when(area >= PORTRAIT_AREA, "closeup")
        .when((count >= 2) & (area >= GROUP_AREA), "group")
    )


def arbitrated(verdict: Column, text_boxes: Column, text_area: Column, screenshot: Column, luma: Column) -> Column:
    """Category by the first rule that holds: persons, text, screenshot, night."""
    return (
        F.when(verdict == "street", "street")
        .when(verdict.isin("closeup", "group"), "portrait")
        .when((text_boxes >= 2) & (text_area >= TEXT_AREA), "document")
        .when(screenshot, "document")
        .when(luma < NIGHT_LUMA, "night_scene")
        .otherwise("other")
    )


#: The region that the map shows, in degrees.
MAP_WEST, MAP_EAST, MAP_SOUTH, MAP_NORTH = 73.5, 135.1, 18.0, 53.6


def on_map(lon: Column, lat: Column) -> Column:
    return lon.between(MAP_WEST, MAP_EAST) & lat.between(MAP_SOUTH, MAP_NORTH)


def map_point(lon: Column, lat: Column, width: float, pad: float = 0.0) -> Column:
    """Struct (x, y) of an equirectangular map of the given width, y downwards."""
    scale = (width - 2 * pad) / (MAP_EAST - MAP_WEST)
    return F.struct((pad + (lon - MAP_WEST) * scale).alias("x"), (pad + (MAP_NORTH - lat) * scale).alias("y"))


def point_radius(count: Column) -> Column:
    """Radius that grows with the logarithm of the count, from 2.6 to 13."""
    return F.least(F.lit(13.0), 2.6 + 2.2 * F.log10(F.greatest(F.lit(1), count)) * 1.6)
