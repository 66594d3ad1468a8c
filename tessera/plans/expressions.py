"""Scalar rules, look-ups and small helpers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import photo, text, vectors
from tessera.functions.paths import is_under
from tessera.operators.filters import in_given_order, page
from tessera.operators.prefixes import owners
from tessera.sources.media import distinct_files
from tessera.sources.tables import table
from tessera.sources.views import albums, photos


def screenshot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which marker a path has, and whether it lies below a root in any case and with any separator."""
    n = F.col("o_orderkey")
    folder = F.element_at(F.array(*map(F.lit, ["/Lib/Screenshots/", "C:\\Users\\SCREENSHOT_1", "/lib/DCIM/", "/LIB/截图/", "/library/x/"])), (n % 5).cast("int") + 1)
    path = F.concat(folder, n, F.lit(".png"))
    return table(spark, sf_dir, "orders").select(n.alias("id"), text.screenshot_marker(path).alias("marker"), is_under(path, F.lit("\\lib\\")).alias("under"))


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a preview: long texts cut, nulls spelled out."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cell_text(F.col("text"))).alias("shown"), text.cell_text(F.when(F.col("doc_id") % 3 > 0, F.col("n_chars"))).alias("chars"))


def screen_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    w, h = F.col("l_quantity").cast("int") * 40, F.col("l_partkey") % 50 * 40
    return i.select(w.alias("w"), h.alias("h")).groupBy("w", "h").agg(F.count("*").alias("n")).withColumn("near", photo.near_screen_ratio(F.col("w"), F.col("h"), [(16, 9), (9, 16), (4, 3)]))


def rows_in_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the documents that a caller asks for, in the order of asking; unknown ones stay with nulls."""
    asked = [str(i * 37 % 1009) for i in range(900)]
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")
    return in_given_order(asked, rows, "doc_id").select(F.col("_place").alias("place"), "doc_id", "quality", "toxic")


def owning_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every album that owns a path, a row each."""
    return owners(photos(spark, sf_dir).select("id", "path"), albums(spark, sf_dir).select("id", "root")).groupBy("root_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def unlimited_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page without a limit is the whole list."""
    return page(photos(spark, sf_dir).select("id", "score"), [F.desc("score"), F.col("id")], 3, -1)


def same_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file reached through several albums counts once, in the least of them."""
    files = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("/real/"), "l_partkey").alias("target"), F.col("l_suppkey").alias("album_id"), F.concat(F.lit("/link/"), "l_suppkey", F.lit("/"), "l_partkey").alias("path"))
    return distinct_files(files, "target")


def merged_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of two persons' centroids by their numbers of faces."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    mean = vectors.weighted_mean(F.col("v"), F.col("vec_id") % 5 + 1, F.col("w"), F.lit(3))
    return e.join(other, "vec_id").select("vec_id", F.transform(mean, lambda x: vectors.rounded(x)).alias("mean"))


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists read from JSON of any quality and written again, names that are no codes."""
    n = F.col("o_orderkey")
    raw = F.element_at(F.array(*map(F.lit, ['["P1","P2"]', "[]", "", "no json", '{"a":1}', '["é \\"q\\""]', '["x", "x"]'])), (n % 7).cast("int") + 1)
    listed = text.json_list(F.when(n % 11 > 0, raw))
    name = F.when(n % 4 == 0, F.lit(" Ann ")).when(n % 4 == 1, F.lit(" P7 ")).when(n % 4 == 2, F.lit("  "))
    return table(spark, sf_dir, "orders").select(n.alias("id"), F.size(listed).alias("n"), text.dumped_list(listed).alias("written"), text.real_name(F.lit("P7"), name).alias("name"))


def short_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    place = F.concat_ws(" · ", *(F.when(n % (i + 2) > 0, F.concat(F.lit(f"p{i}-"), n % 10)) for i in range(4)))
    return table(spark, sf_dir, "orders").select(n.alias("id"), text.shortened_place(place).alias("place"))


def gps_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees from minutes and seconds, local time from a GPS time, ratios with a zero below."""
    n = F.col("o_orderkey")
    where = F.element_at(F.array(*map(F.lit, ["n", "s", "W", "E"])), (n % 4).cast("int") + 1)
    value = photo.dms_to_decimal((n % 180).cast("double"), (n % 60).cast("double"), (n % 3600).cast("double") / 60, where)
    return table(spark, sf_dir, "orders").select(
        n.alias("id"), F.round(value, 6).alias("degrees"), F.date_format(photo.gps_local_time(F.col("o_orderdate").cast("timestamp")), "yyyy-MM-dd HH:mm").alias("local"), F.round(photo.ratio(n.cast("double"), (n % 5).cast("double")), 6).alias("ratio"),
    )


def shoot_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera times with and without quotes, short and long."""
    n = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy:MM:dd")
    raw = F.when(n % 3 == 0, F.concat(F.lit('"'), day, F.lit(' 10:11:12"'))).when(n % 3 == 1, day).otherwise(F.concat(F.lit("  "), day, F.lit(" 01:02:03.55 ")))
    return table(spark, sf_dir, "orders").select(n.alias("id"), photo.format_shoot_time(raw).alias("time"))


def saved_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a smaller file saves in percent, and scores of matches in thousandths."""
    n = F.col("o_orderkey")
    after = F.col("o_totalprice").cast("double") * (n % 13) / 10
    return table(spark, sf_dir, "orders").select(n.alias("id"), photo.saved_percent(F.when(n % 9 > 0, F.col("o_totalprice").cast("double")), after).alias("saved"), photo.match_score(F.when(n % 8 > 0, (n % 17) / 8.0 - 0.5)).alias("score"))


def parsed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    raw = F.when(n % 5 == 0, F.lit("[1, 2]")).otherwise(F.concat(F.lit("["), n % 40, F.lit(", "), n % 30, F.lit(","), n % 70, F.lit(" ,-"), n % 3, F.lit("]")))
    raw = F.when(n % 3 == 0, F.replace(raw, F.lit("-"), F.lit("9"))).otherwise(raw)
    box = photo.parse_bbox(raw)
    return table(spark, sf_dir, "orders").select(n.alias("id"), *(box[c].alias(c) for c in ("x1", "y1", "x2", "y2")))


def tone_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    luma = F.when(n % 7 > 0, n % 2560 / 10.0)
    return table(spark, sf_dir, "orders").select(n.alias("id"), photo.tone_class(luma).alias("tone"))


QUERIES = {
    f.__name__: f
    for f in (
        screenshot_paths, cell_texts, screen_ratios, rows_in_input_order, owning_albums, unlimited_page, same_targets, merged_means, json_values, short_places, gps_values, shoot_times, saved_sizes, parsed_boxes, tone_classes,
    )
}

_R = "(SELECT o_orderkey AS n, * FROM orders)"
_UNIT = "list_transform(m, lambda x: round(x / sqrt(list_inner_product(m, m)), 6))"
ORACLES = {
    "screenshot_paths": f"""WITH r AS (SELECT n AS id, ['/Lib/Screenshots/', 'C:' || chr(92) || 'Users' || chr(92) || 'SCREENSHOT_1', '/lib/DCIM/', '/LIB/截图/', '/library/x/'][n % 5 + 1] || n || '.png' AS p FROM {_R})
        SELECT id, CASE WHEN contains(lower(p), 'screenshot') THEN 'screenshot' WHEN contains(p, '截图') THEN '截图' END AS marker, starts_with(lower(p), '/lib/') AS under FROM r""",
    "cell_texts": """WITH r AS (SELECT doc_id, text AS t, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS c FROM documents)
        SELECT doc_id, md5(coalesce(CASE WHEN length(t) > 200 THEN t[1:200] || '…（共 ' || length(t) || ' 字符）' ELSE t END, 'NULL')) AS shown, coalesce(c::VARCHAR, 'NULL') AS chars FROM r""",
    "screen_ratios": """WITH i AS (SELECT l_quantity::INT * 40 AS w, l_partkey % 50 * 40 AS h, count(*) AS n FROM lineitem GROUP BY 1, 2)
        SELECT w, h, n, coalesce(w > 0 AND h > 0 AND len(list_filter([16 / 9, 9 / 16, 4 / 3], lambda a: abs(w / h - a) / a < 0.06)) > 0, false) AS near FROM i""",
    "rows_in_input_order": "WITH a AS (SELECT i::INT AS place, (i * 37 % 1009)::VARCHAR AS doc_id FROM range(900) t(i)) SELECT place, a.doc_id, quality, toxic FROM a LEFT JOIN labels l ON l.doc_id::VARCHAR = a.doc_id",
    "owning_albums": "WITH photos AS (SELECT o_orderkey AS id, '/lib/' || coalesce(n_name, '?') || '/' || o_custkey || '/' || o_orderkey || '.jpg' AS path FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey), albums AS (SELECT c_custkey AS id, '/lib/' || n_name || '/' || c_custkey AS root FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT a.id AS root_id, count(*) AS n, min(p.id) AS first FROM photos p JOIN albums a ON starts_with(p.path, a.root || '/') GROUP BY 1",
    "unlimited_page": "SELECT o_orderkey AS id, o_totalprice AS score FROM orders",
    "same_targets": "SELECT '/real/' || l_partkey AS target, min(l_suppkey) AS album_id, '/link/' || min(l_suppkey) || '/' || l_partkey AS path FROM lineitem GROUP BY l_partkey",
    "merged_means": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, list_transform(list_zip(a.v, b.v), lambda z: (z[1] * (a.vec_id % 5 + 1) + z[2] * 3) / (a.vec_id % 5 + 4)) AS m FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, {_UNIT} AS mean FROM p""",
    "json_values": f"""SELECT n AS id, CASE WHEN n % 11 = 0 THEN 0 ELSE [2, 0, 0, 0, 0, 1, 2][n % 7 + 1] END AS n,
        CASE WHEN n % 11 > 0 THEN ['["P1","P2"]', NULL, NULL, NULL, NULL, '["é \\"q\\""]', '["x","x"]'][n % 7 + 1] END AS written, CASE WHEN n % 4 = 0 THEN 'Ann' END AS name FROM {_R}""",
    "short_places": f"""WITH p AS (SELECT n AS id, list_filter([CASE WHEN n % 2 > 0 THEN 'p0-' || n % 10 END, CASE WHEN n % 3 > 0 THEN 'p1-' || n % 10 END, CASE WHEN n % 4 > 0 THEN 'p2-' || n % 10 END, CASE WHEN n % 5 > 0 THEN 'p3-' || n % 10 END], lambda x: x IS NOT NULL) AS p FROM {_R})
        SELECT id, coalesce(array_to_string(p[-2:], ' · '), '') AS place FROM p""",
    "gps_values": f"""SELECT n AS id, round((n % 180 + n % 60 / 60.0::DOUBLE + n % 3600 / 60.0::DOUBLE / 3600.0::DOUBLE) * CASE WHEN n % 4 IN (1, 2) THEN -1 ELSE 1 END, 6) AS degrees, strftime(o_orderdate::TIMESTAMP + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local,
        CASE WHEN n % 5 = 0 THEN 0.0::DOUBLE ELSE round(n::DOUBLE / (n % 5), 6) END AS ratio FROM {_R}""",
    "shoot_times": f"""SELECT n AS id, strftime(o_orderdate, '%Y-%m-%d') || CASE n % 3 WHEN 0 THEN ' 10:11:12' WHEN 1 THEN '' ELSE ' 01:02:03' END AS time FROM {_R}""",
    "saved_sizes": f"""WITH r AS (SELECT n, CASE WHEN n % 9 > 0 THEN o_totalprice::DOUBLE END AS b, o_totalprice::DOUBLE * (n % 13) / 10 AS a FROM {_R}), p AS (SELECT *, round((1 - a / b) * 100)::INT AS pct FROM r)
        SELECT n AS id, CASE WHEN b IS NULL OR b <= 0 THEN '' WHEN pct > 0 THEN '体积减少 ' || pct || '%' ELSE '体积未减少' END AS saved, round(least(1.0, greatest(0.0, CASE WHEN n % 8 > 0 THEN n % 17 / 8.0::DOUBLE - 0.5 ELSE 0 END)) * 1000)::INT AS score FROM p""",
    "parsed_boxes": f"""WITH b AS (SELECT n, CASE WHEN n % 5 > 0 THEN n % 40 END AS x1, n % 30 AS y1, n % 70 AS x2, CASE WHEN n % 3 = 0 THEN 90 + n % 3 ELSE -(n % 3) END AS y2 FROM {_R}), k AS (SELECT *, x2 > x1 AND y2 > y1 AS fits FROM b)
        SELECT n AS id, CASE WHEN fits THEN x1 END AS x1, CASE WHEN fits THEN y1 END AS y1, CASE WHEN fits THEN x2 END AS x2, CASE WHEN fits THEN y2 END AS y2 FROM k""",
    "tone_classes": f"SELECT n AS id, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 2560 / 10.0 < 85 THEN 'low' WHEN n % 2560 / 10.0 > 170 THEN 'high' ELSE 'mid' END AS tone FROM {_R}",
}
