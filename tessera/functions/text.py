"""Text rules of the description index: cleaning, time segments, tags, fingerprints, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the application's.
SCENE_STOPWORDS = ["其他", "other", "未知", "unknown", "none", "null", "无", "未识别", "n/a"]
SEGMENT_SEPARATOR = " · "
FINGERPRINT_SEPARATOR = "\x1f"
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
SCREENSHOT_MARKERS = ["screenshot", "截屏", "截图", "屏幕截图", "snipaste", "scr_"]


def empty_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def season_of(month: Column) -> Column:
    return F.when(month.between(3, 5), "春").when(month.between(6, 8), "夏").when(month.between(9, 11), "秋").otherwise("冬")


def season_key(month: Column) -> Column:
    return F.when(month.between(3, 5), "spring").when(month.between(6, 8), "summer").when(month.between(9, 11), "autumn").otherwise("winter")


def time_segment(shoot_time: Column) -> Column:
    """Year and month of a time text, the season if only the month is usable, '' otherwise."""
    parts = F.split(F.split(F.trim(F.coalesce(shoot_time, F.lit(""))), " ")[0], "-")
    year, month = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    year, month = F.when(year > 1900, year), F.when(month.between(1, 12), month)
    return (
        F.when(year.isNotNull() & month.isNotNull(), F.concat(year.cast("string"), F.lit("年"), month.cast("string"), F.lit("月")))
        .when(year.isNull() & month.isNotNull(), season_of(month))
        .otherwise("")
    )


def is_person_code(c: Column) -> Column:
    return c.rlike("^[pP][0-9]+$")


def clean_scene(content: Column) -> Column:
    """Lower-cased words without stop words and person codes, each once, in order."""
    words = F.split(F.lower(F.coalesce(content, F.lit(""))), r"[\s·]+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(SCENE_STOPWORDS) & ~is_person_code(w))
    return F.array_join(F.array_distinct(kept), " ")


def joined_segments(segments: list[Column], separator: str = SEGMENT_SEPARATOR) -> Column:
    """The non-empty segments in order."""
    return F.concat_ws(separator, *(empty_to_null(s) for s in segments))


def normalised_tags(tags: Column, longest: int = 30, most: int = 20) -> Column:
    """Trimmed distinct tags of 1 to ``longest`` characters, at most ``most``."""
    trimmed = F.transform(tags, lambda t: F.trim(t))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda t: (t != "") & (F.char_length(t) <= longest))), 1, most)


def real_name(person_id: Column, name: Column) -> Column:
    trimmed = F.trim(name)
    return F.when((trimmed != "") & (trimmed != F.trim(person_id)), trimmed)


def json_list(raw: Column) -> Column:
    """A JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def dumped_list(values: Column) -> Column:
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.to_json(values))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as 16 hex digits.

    The state is a decimal since a product of longs does not wrap in ANSI mode.
    """
    digits = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    codes = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest((F.char_length(digits) / 2).cast("int") - 1, F.lit(0))), lambda i: i * 2 < F.char_length(digits)),
        lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"),
    )
    modulus = F.lit(str(1 << 64)).cast("decimal(20,0)")

    def step(state: Column, byte: Column) -> Column:
        low = (state % 256).cast("int")
        mixed = state - low + low.bitwiseXOR(byte)
        return ((mixed.cast("decimal(20,0)") * F.lit(str(FNV_PRIME)).cast("decimal(13,0)")) % modulus).cast("decimal(20,0)")

    final = F.aggregate(codes, F.lit(str(FNV_OFFSET)).cast("decimal(20,0)"), step)
    return F.lower(F.lpad(F.conv(final.cast("string"), 10, 16), 16, "0"))


def screenshot_marker(path: Column) -> Column:
    """The first marker, in their order, that the lower-cased path contains."""
    return F.coalesce(*(F.when(F.lower(path).contains(m), F.lit(m)) for m in SCREENSHOT_MARKERS))


def shortened_place(place: Column) -> Column:
    parts = F.split(place, " · ")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), " · ")


def folder_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"""[/\\:*?"<>|]""", "_")


def redacted(value: Column) -> Column:
    """A masked form of values that look like credentials or personal data, null for others."""
    t = F.trim(value)
    low, n, solid = F.lower(t), F.char_length(t), ~t.rlike(r"\s")
    hashes = low.startswith("$argon2") | low.startswith("$2a$") | low.startswith("$2b$") | low.startswith("$pbkdf2")
    mail = solid & t.rlike(r"^[^@]+@[^@]*\.[^@]*$")
    return (
        F.when(t == "", F.lit(None).cast("string"))
        .when(hashes, F.lit("<口令哈希 · 已打码>"))
        .when(mail, F.concat(F.left(t, F.lit(1)), F.lit("***@"), F.substring_index(t, "@", -1)))
        .when(t.rlike("^1[0-9]{10}$"), F.concat(F.substring(t, 1, 3), F.lit("****"), F.substring(t, 8, 4)))
        .when(t.rlike("^[0-9]{17}[0-9xX]$"), F.concat(F.substring(t, 1, 2), F.lit("**********"), F.substring(t, 17, 2)))
        .when((n >= 32) & t.rlike(r"^[A-Za-z0-9_=+/.-]+$"), F.concat(F.lit("<疑似令牌/密文 "), n.cast("string"), F.lit(" 字符 · 已打码>")))
    )


def cell_text(value: Column, longest: int = 200) -> Column:
    """Text of a cell: NULL spelled out, long texts cut with a note of their length."""
    text = value.cast("string")
    n = F.char_length(text)
    return F.coalesce(F.when(n > longest, F.concat(F.left(text, F.lit(longest)), F.lit("…（共 "), n.cast("string"), F.lit(" 字符）"))).otherwise(text), F.lit("NULL"))


#: Endings of the tables that a full-text index keeps for itself.
SHADOW_ENDINGS = ["_data", "_idx", "_content", "_docsize", "_config", "_segments"]


def is_shadow_table(name: Column) -> Column:
    return name.contains("_fts") & name.rlike(f"({'|'.join(SHADOW_ENDINGS)})$")


def loose_object(raw: Column) -> Column:
    """JSON text of the object in a text that may have a code fence or words around it; '{}' where there is none."""
    body = F.btrim(F.regexp_replace(F.btrim(raw, F.lit(" \t\r\n")), r"^```(?:json)?|```$", ""), F.lit(" \t\r\n"))
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)

    def valid(c: Column) -> Column:
        return F.when(F.json_object_keys(c).isNotNull(), c)

    return F.coalesce(valid(body), valid(inner), F.lit("{}"))
