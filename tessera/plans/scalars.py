"""Scalar rules applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, photo, text
from tessera.sources.tables import table
from tessera.sources.views import PHOTOS_SQL, photos


def clean_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = F.concat_ws(" ", F.lit("Other"), "lang", "source", F.lit("P001 未知·"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_scene(scene).alias("scene"))


def time_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("tone") == "P", F.concat(F.lit("0000"), F.substring("shoot_time", 5, 15))).when(F.col("tone") == "F", F.col("shoot_time"))
    return photos(spark, sf_dir).groupBy(text.time_segment(t).alias("segment")).agg(F.count("*").alias("n"))


def build_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description and its fingerprint."""
    rows = photos(spark, sf_dir)
    segments = [text.time_segment(F.col("shoot_time")), F.col("location"), F.when(F.col("tone") == "F", F.col("category"))]
    return rows.select("id", text.joined_segments(segments).alias("description"), text.fnv1a(text.joined_segments(segments, text.FINGERPRINT_SEPARATOR)).alias("fingerprint"))


def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", text.fnv1a(F.col("url")).alias("h"))


def redact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    value = (
        F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("user"), key, F.lit("@mail.example")))
        .when(F.col("c_custkey") % 6 == 1, F.concat(F.lit("1"), F.lpad(key, 10, "0")))
        .when(F.col("c_custkey") % 6 == 2, F.concat(F.lpad(key, 17, "1"), F.lit("X")))
        .when(F.col("c_custkey") % 6 == 3, F.concat(F.lit("$2b$"), key))
        .when(F.col("c_custkey") % 6 == 4, F.rpad(key, 40, "ab"))
        .otherwise(F.col("c_name"))
    )
    return c.select("c_custkey", text.redacted(value).alias("masked"))


def format_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shutter, aperture and focal texts from item numbers."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n"))
    return rows.select(
        "l_quantity", "l_discount", "n",
        photo.format_shutter(F.when(d > 0.05, q / 2).otherwise(1 / (q * 4))).alias("shutter"),
        photo.format_aperture(q / 4).alias("aperture"), photo.format_focal(q / 2).alias("focal"),
    )


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", paths.base_name(url).alias("base"), paths.dir_name(url).alias("dir"), paths.path_key(url).alias("key"))


def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos by kind, their extension made up from the key."""
    extensions = F.array(*map(F.lit, ["jpg", "PNG", "gif", "webp", "mp4", "mov", "txt", "heic"]))
    name = F.concat(F.regexp_replace("path", "jpg$", ""), F.get(extensions, (F.col("id") % 8).cast("int")))
    return photos(spark, sf_dir).groupBy(paths.media_kind(name).alias("kind")).agg(F.count("*").alias("n"))


def crop_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred crops of the sizes that parts have, to 4:3."""
    aspect = photo.parse_aspect(F.lit("4:3"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 3).alias("w"), (F.col("p_partkey") % 900 + 17).cast("int").alias("h"))
    box = photo.crop_rectangle(F.col("w"), F.col("h"), aspect["w"], aspect["h"])
    return rows.withColumn("box", box).select("p_partkey", "box.x", "box.y", F.col("box.w").alias("cw"), F.col("box.h").alias("ch"))


def arbitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by the rule cascade, its inputs made up from item numbers."""
    items = table(spark, sf_dir, "lineitem")
    persons, area = F.col("l_linenumber") - 1, F.col("l_discount") * 4
    verdict = photo.person_verdict(persons, area, F.floor(F.col("l_quantity") / 10))
    category = photo.arbitrated(verdict, (F.col("l_quantity") % 4), F.col("l_tax") * 2, F.col("l_quantity") > 40, F.col("l_quantity") * 4)
    return items.groupBy(category.alias("category"), F.coalesce(verdict, F.lit("-")).alias("verdict")).agg(F.count("*").alias("n"))


def batch_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("t"), F.min("value").alias("low"), F.max("value").alias("high"))
    return rows.select("event_type", "n", F.round("t", 4).alias("total"), F.round(F.col("t") / F.col("n"), 6).alias("mean"), "low", "high", photo.format_ms(F.col("high")).alias("high_text"))


def album_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each source in the texts of the client and of the log."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"))
    return rows.select("source", "bytes", photo.format_bytes(F.col("bytes")).alias("client"), photo.format_bytes_log(F.col("bytes")).alias("log"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_scene, time_segments, build_description, fnv_hash, redact_values, format_exposure, path_parts, media_kinds, crop_rectangles, arbitrate, batch_timing, album_sizes,
    )
}

FNV_SQL = """(SELECT lower(lpad(to_hex((list_reduce(list_transform(range(1, octet_length(encode({t})) + 1), lambda i: ('0x' || hex(encode({t}))[2 * i - 1:2 * i])::HUGEINT),
    lambda h, b: (((h - h % 256 + xor((h % 256)::INT, b::INT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT), 14695981039346656037::HUGEINT))::UBIGINT), 16, '0')))"""
ORACLES = {
    "clean_scene": "SELECT doc_id, lang || ' ' || source AS scene FROM documents",
    "time_segments": f"""WITH {PHOTOS_SQL} SELECT CASE WHEN tone = 'F' THEN shoot_time[1:4] || '年' || shoot_time[6:7]::INT || '月'
        WHEN tone = 'P' THEN CASE WHEN shoot_time[6:7]::INT BETWEEN 3 AND 5 THEN '春' WHEN shoot_time[6:7]::INT BETWEEN 6 AND 8 THEN '夏' WHEN shoot_time[6:7]::INT BETWEEN 9 AND 11 THEN '秋' ELSE '冬' END
        ELSE '' END AS segment, count(*) AS n FROM photos GROUP BY 1""",
    "build_description": f"""WITH {PHOTOS_SQL}, d AS (SELECT id, concat_ws(chr(31), shoot_time[1:4] || '年' || shoot_time[6:7]::INT || '月', location, CASE WHEN tone = 'F' THEN category END) AS j FROM photos)
        SELECT id, replace(j, chr(31), ' · ') AS description, {FNV_SQL.format(t="j")} AS fingerprint FROM d""",
    "fnv_hash": f"""SELECT page_id, {FNV_SQL.format(t="url")} AS h FROM pages""",
    "redact_values": """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'u***@mail.example' WHEN 1 THEN '1' || lpad(c_custkey::VARCHAR, 10, '0')[1:2] || '****' || lpad(c_custkey::VARCHAR, 10, '0')[7:10]
        WHEN 2 THEN lpad(c_custkey::VARCHAR, 17, '1')[1:2] || '**********' || lpad(c_custkey::VARCHAR, 17, '1')[17:17] || 'X' WHEN 3 THEN '<口令哈希 · 已打码>' WHEN 4 THEN '<疑似令牌/密文 40 字符 · 已打码>' END AS masked FROM customer""",
    "format_exposure": """WITH r AS (SELECT l_quantity, l_discount, count(*) AS n, CASE WHEN l_discount > 0.05 THEN l_quantity / 2 ELSE 1 / (l_quantity * 4) END AS s FROM lineitem GROUP BY 1, 2)
        SELECT l_quantity, l_discount, n, CASE WHEN s >= 1 AND s = round(s) THEN format('{:.0f}s', s) WHEN s >= 1 THEN format('{:.1f}s', s) ELSE format('1/{:.0f}s', round(1 / s)) END AS shutter,
        'f/' || (round(l_quantity / 4 * 10 + 1e-9) / 10)::DECIMAL(9, 1) AS aperture, CASE WHEN l_quantity / 2 = round(l_quantity / 2) THEN format('{:.0f}mm', l_quantity / 2) ELSE format('{:.1f}mm', l_quantity / 2) END AS focal FROM r""",
    "path_parts": r"""WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)
        SELECT page_id, regexp_extract(u, '([^/\\]*)$', 1) AS base, regexp_extract(u, '^(.*)[/\\][^/\\]*$', 1) AS dir, lower(regexp_replace(replace(u, '/', '\'), '\\+$', '')) AS key FROM u""",
    "media_kinds": """SELECT CASE o_orderkey % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'animated' WHEN 3 THEN 'animated' WHEN 4 THEN 'video' WHEN 5 THEN 'video' WHEN 7 THEN 'image' END AS kind, count(*) AS n FROM orders GROUP BY 1""",
    "crop_rectangles": """WITH r AS (SELECT p_partkey, p_size * 40 + 3 AS w, (p_partkey % 900 + 17)::INT AS h FROM part),
        c AS (SELECT *, greatest(1, h * 4 // 3)::INT AS cw0, greatest(1, w * 3 // 4)::INT AS ch0 FROM r)
        SELECT p_partkey, CASE WHEN w * 3 > h * 4 THEN (w - cw0) // 2 WHEN w * 3 < h * 4 THEN 0 END::INT AS x, CASE WHEN w * 3 > h * 4 THEN 0 WHEN w * 3 < h * 4 THEN (h - ch0) // 2 END::INT AS y,
        CASE WHEN w * 3 > h * 4 THEN cw0 WHEN w * 3 < h * 4 THEN w END::INT AS cw, CASE WHEN w * 3 > h * 4 THEN h WHEN w * 3 < h * 4 THEN ch0 END::INT AS ch FROM c""",
    "arbitrate": """WITH r AS (SELECT l_linenumber - 1 AS n, l_discount * 4 AS a, floor(l_quantity / 10) AS v, l_quantity % 4 AS tb, l_tax * 2 AS ta, l_quantity AS q FROM lineitem),
        p AS (SELECT *, CASE WHEN n <= 0 THEN NULL WHEN n >= 3 AND a < 0.20::DOUBLE AND NOT (v >= 4 AND a < 0.03::DOUBLE) THEN 'street' WHEN a >= 0.30::DOUBLE THEN 'closeup' WHEN n >= 2 AND a >= 0.10::DOUBLE THEN 'group' END AS verdict FROM r)
        SELECT CASE WHEN verdict = 'street' THEN 'street' WHEN verdict IN ('closeup', 'group') THEN 'portrait' WHEN tb >= 2 AND ta >= 0.12::DOUBLE THEN 'document' WHEN q > 40 THEN 'document' WHEN q * 4 < 45 THEN 'night_scene' ELSE 'other' END AS category,
        coalesce(verdict, '-') AS verdict, count(*) AS n FROM p GROUP BY 1, 2""",
    "batch_timing": """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high,
        CASE WHEN max(value) >= 100 THEN format('{:.0f}', max(value)) WHEN max(value) >= 10 THEN format('{:.1f}', max(value)) ELSE format('{:.2f}', max(value)) END AS high_text FROM events GROUP BY 1""",
    "album_sizes": """WITH r AS (SELECT source, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1)
        SELECT source, bytes, CASE WHEN bytes / 1024 >= 1024 * 1024 THEN format('{:.1f} GB', bytes / 1073741824.0) WHEN bytes / 1024 >= 1024 THEN format('{:.1f} MB', bytes / 1048576.0) ELSE format('{:.0f} KB', round(bytes / 1024.0)) END AS client,
        CASE WHEN bytes >= 1073741824 THEN format('{:.2f}GB', bytes / 1073741824.0) WHEN bytes >= 1048576 THEN format('{:.1f}MB', bytes / 1048576.0) WHEN bytes >= 1024 THEN format('{:.0f}KB', bytes / 1024.0) ELSE bytes || 'B' END AS log FROM r""",
}
