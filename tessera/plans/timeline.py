"""Timeline and overview queries over photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import season_key
from tessera.operators.filters import month_slice
from tessera.operators.numbering import numbered
from tessera.sources.tables import table
from tessera.sources.views import PHOTOS_SQL, photos


def _month(c: str = "shoot_time") -> Column:
    return F.coalesce(F.substring(c, 1, 7), F.lit(""))


def timeline_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per month, the bucket of rows without a date last."""
    month = F.coalesce(F.date_format("o_orderdate", "yyyy-MM"), F.lit(""))
    return table(spark, sf_dir, "orders").groupBy(month.alias("ym")).agg(F.count("*").alias("n")).orderBy(F.col("ym") == "", "ym")


def timeline_month_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = month_slice(photos(spark, sf_dir), "1997", "03")
    return rows.select("id", "path", "shoot_time").orderBy("id").offset(20).limit(50)


def timeline_unrecorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose time, blanked for finished orders here, is missing."""
    blanked = photos(spark, sf_dir).withColumn("shoot_time", F.when(F.col("tone") == "P", None).when(F.col("tone") == "F", "").otherwise(F.col("shoot_time")))
    return month_slice(blanked, "", "").groupBy("location").agg(F.count("*").alias("n"))


def timeline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All photos with their place in time order, rows without a time last."""
    rows = photos(spark, sf_dir).withColumn("shoot_time", F.when(F.col("tone") != "P", F.col("shoot_time")))
    return numbered(rows.select("id", "shoot_time", F.col("shoot_time").isNull().alias("no")), [], ["no", "shoot_time", "id"]).select("id", "shoot_time", "place")


def overview_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library totals in one pass."""
    year = F.when(F.col("shoot_time").rlike("^[12][0-9]{3}"), F.substring("shoot_time", 1, 4).cast("int"))
    return photos(spark, sf_dir).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("location").isNull() | (F.col("location") == "")).alias("no_location"),
        F.count_if(F.col("category") == "1-URGENT").alias("urgent"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.countDistinct(F.substring("shoot_time", 1, 7)).alias("months"),
    )


def overview_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and greatest key of each table, joined: equal signatures mean that a cached overview still holds."""
    parts = [
        table(spark, sf_dir, name).agg(F.concat_ws(":", F.count("*"), F.max(key)).alias("s")).select(F.lit(i).alias("i"), "s")
        for i, (name, key) in enumerate((("orders", "o_orderkey"), ("documents", "doc_id"), ("embeddings", "vec_id")))
    ]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]), "|").alias("signature"))


def on_this_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of the same day in earlier years, latest year first."""
    rows = photos(spark, sf_dir).where((F.substring("shoot_time", 6, 5) == "06-15") & (F.substring("shoot_time", 1, 4) < "2001"))
    return rows.groupBy(F.substring("shoot_time", 1, 4).alias("year")).agg(F.count("*").alias("n"), F.max("id").alias("newest_id"))


def recent_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).orderBy(F.desc("id")).limit(6).select("id", "path")


def _memories(rows: DataFrame, key: str) -> DataFrame:
    """Count, commonest place and middle photo of each period, photos of tone F being preferred as hero.

    The middle is found by rank within (period, preferred), and only its row is kept.
    """
    preferred = (F.col("tone") == "F").alias("pref")
    keyed = rows.select(key, "id", "shoot_time", "location", preferred)
    places = keyed.where("location is not null").groupBy(key, "location").agg(F.count("*").alias("c"))
    top = places.groupBy(key).agg(F.min(F.struct((-F.col("c")).alias("c"), "location")).alias("t")).select(key, F.col("t.location").alias("top_location"))
    counts = keyed.groupBy(key).agg(F.count("*").alias("n"), F.count_if("pref").alias("n_pref"))
    ranked = numbered(keyed, [key, "pref"], ["shoot_time", "id"], "rn").join(F.broadcast(counts), key)  # a row a period
    pool = F.when(F.col("n_pref") > 0, F.col("n_pref")).otherwise(F.col("n"))
    hero = ranked.where((F.col("pref") == (F.col("n_pref") > 0)) & (F.col("rn") == F.floor(pool / 2))).select(key, F.col("id").alias("hero_id"))
    return counts.join(hero, key).join(top, key, "left").select(key, "n", "hero_id", "top_location")


def memories_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memories(photos(spark, sf_dir).withColumn("ym", F.substring("shoot_time", 1, 7)), "ym")


def memories_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memories(photos(spark, sf_dir).withColumn("year", F.substring("shoot_time", 1, 4).cast("int")), "year")


_MEMORIES_SQL = """
WITH {photos}, k AS (SELECT {key} AS {name}, id, shoot_time, location, tone = 'F' AS pref FROM photos),
c AS (SELECT {name}, count(*) AS n, count(*) FILTER (pref) AS n_pref FROM k GROUP BY 1),
p AS (SELECT {name}, location, row_number() OVER (PARTITION BY {name} ORDER BY count(*) DESC, location) AS r FROM k WHERE location IS NOT NULL GROUP BY 1, 2),
h AS (SELECT k.{name}, id, row_number() OVER (PARTITION BY k.{name} ORDER BY shoot_time, id) AS r, CASE WHEN n_pref > 0 THEN n_pref ELSE n END AS m
      FROM k JOIN c USING ({name}) WHERE pref = (n_pref > 0))
SELECT c.{name}, c.n, h.id AS hero_id, p.location AS top_location
FROM c JOIN h ON h.{name} = c.{name} AND h.r = h.m // 2 + 1 LEFT JOIN p ON p.{name} = c.{name} AND p.r = 1"""


def season_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per year, season and month with all subtotals; the tree of the time view in flat form."""
    rows = photos(spark, sf_dir).select(F.substring("shoot_time", 1, 4).cast("int").alias("year"), F.substring("shoot_time", 6, 2).cast("int").alias("month"))
    return rows.withColumn("season", season_key(F.col("month"))).rollup("year", "season", "month").agg(F.count("*").alias("n"))


def time_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums under the year, season and month of their latest photo, a row each with its place in the month."""
    rows = photos(spark, sf_dir).groupBy("album_id").agg(F.max("shoot_time").alias("t"))
    keyed = rows.select(F.substring("t", 1, 4).cast("int").alias("year"), F.substring("t", 6, 2).cast("int").alias("month"), "album_id")
    placed = numbered(keyed, ["year", "month"], ["album_id"])
    return placed.select("year", season_key(F.col("month")).alias("season"), "month", "album_id", (F.col("place") + 1).alias("place"))


def time_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums by year, season and month, latest first: by their latest photo, else by when they were made, and in a group of their own if neither is known."""
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.when(F.col("c_custkey") % 5 > 0, F.concat(1990 + F.col("c_custkey") % 9, F.lit("-"), F.lpad((F.col("c_custkey") % 12 + 1).cast("string"), 2, "0"))).alias("made"))
    shot = photos(spark, sf_dir).where("album_id % 3 > 0").groupBy("album_id").agg(F.substring(F.max("shoot_time"), 1, 7).alias("ym"))
    rows = made.join(shot, "album_id", "left").withColumn("ym", F.coalesce("ym", "made"))
    keyed = rows.select("album_id", F.coalesce(F.substring("ym", 1, 4).cast("int"), F.lit(0)).alias("year"), F.substring("ym", 6, 2).cast("int").alias("month"))
    named = keyed.withColumn("season", F.when(F.col("month").isNotNull(), season_key(F.col("month"))))
    latest = named.groupBy("year", "season").agg(F.max("month").alias("latest"))
    placed = latest.select(F.col("year").alias("y"), F.col("season").alias("s"), F.row_number().over(Window.partitionBy("year").orderBy(F.desc("latest"))).alias("season_place"))  # four seasons a year at most
    return named.join(placed, (F.col("year") == F.col("y")) & F.col("season").eqNullSafe(F.col("s"))).select("album_id", "year", "season", "month", "season_place")


def dense_month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months of one year, empty ones included, relative to the fullest."""
    counted = photos(spark, sf_dir).where(F.substring("shoot_time", 1, 4) == "1996").groupBy(F.substring("shoot_time", 6, 2).cast("int").alias("month")).agg(F.count("*").alias("c"))
    dense = spark.range(1, 13).select(F.col("id").cast("int").alias("month")).join(counted, "month", "left").select("month", F.coalesce("c", F.lit(0)).alias("n"))
    peak = dense.agg(F.max("n").alias("peak"))
    return dense.crossJoin(peak).select("month", "n", F.round(F.try_divide(F.col("n"), F.col("peak")), 6).alias("share"))


def year_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = photos(spark, sf_dir).groupBy(F.substring("shoot_time", 1, 4).alias("year")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "year").limit(5).orderBy("year")


def place_top5_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = photos(spark, sf_dir).where("location is not null").groupBy("location").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "location").limit(5)
    peak = top.agg(F.max("n").alias("peak"))
    return top.crossJoin(peak).select("location", "n", F.round(F.col("n") / F.col("peak"), 6).alias("ratio"))


def cumulative_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset of each month in the scroll view: photos before it, months before it."""
    months = photos(spark, sf_dir).groupBy(_month().alias("ym")).agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("ym")).rowsBetween(Window.unboundedPreceding, -1)
    return months.select("ym", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("photos_before"), F.count("*").over(before).alias("months_before"))


QUERIES = {
    f.__name__: f
    for f in (
        timeline_index, timeline_month_slice, timeline_unrecorded, timeline_order, overview_scalar, overview_signature, on_this_day, recent_top6,
        memories_month, memories_year, season_rollup, time_tree, time_groups, dense_month_bars, year_top5, place_top5_ratio, cumulative_layout,
    )
}

_SEASON = "CASE WHEN {m} BETWEEN 3 AND 5 THEN 'spring' WHEN {m} BETWEEN 6 AND 8 THEN 'summer' WHEN {m} BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END"
ORACLES = {
    "timeline_index": "SELECT coalesce(strftime(o_orderdate, '%Y-%m'), '') AS ym, count(*) AS n FROM orders GROUP BY 1",
    "timeline_month_slice": f"WITH {PHOTOS_SQL} SELECT id, path, shoot_time FROM photos WHERE shoot_time LIKE '1997-03%' ORDER BY id LIMIT 50 OFFSET 20",
    "timeline_unrecorded": f"WITH {PHOTOS_SQL} SELECT location, count(*) AS n FROM photos WHERE tone IN ('P', 'F') GROUP BY 1",
    "timeline_order": f"""WITH {PHOTOS_SQL} SELECT id, CASE WHEN tone <> 'P' THEN shoot_time END AS shoot_time,
        row_number() OVER (ORDER BY CASE WHEN tone <> 'P' THEN shoot_time END ASC NULLS LAST, id) - 1 AS place FROM photos""",
    "overview_scalar": f"""WITH {PHOTOS_SQL} SELECT count(*) AS n, count(*) FILTER (location IS NULL OR location = '') AS no_location,
        count(*) FILTER (category = '1-URGENT') AS urgent, min(shoot_time[1:4]::INT) AS first_year, max(shoot_time[1:4]::INT) AS last_year,
        count(DISTINCT shoot_time[1:7]) AS months FROM photos""",
    "overview_signature": """SELECT (SELECT count(*) || ':' || max(o_orderkey) FROM orders) || '|' || (SELECT count(*) || ':' || max(doc_id) FROM documents)
        || '|' || (SELECT count(*) || ':' || max(vec_id) FROM embeddings) AS signature""",
    "on_this_day": f"""WITH {PHOTOS_SQL} SELECT shoot_time[1:4] AS year, count(*) AS n, max(id) AS newest_id FROM photos
        WHERE shoot_time[6:10] = '06-15' AND shoot_time[1:4] < '2001' GROUP BY 1""",
    "recent_top6": f"WITH {PHOTOS_SQL} SELECT id, path FROM photos ORDER BY id DESC LIMIT 6",
    "memories_month": _MEMORIES_SQL.format(photos=PHOTOS_SQL, key="shoot_time[1:7]", name="ym"),
    "memories_year": _MEMORIES_SQL.format(photos=PHOTOS_SQL, key="shoot_time[1:4]::INT", name="year"),
    "season_rollup": f"""WITH {PHOTOS_SQL}, k AS (SELECT shoot_time[1:4]::INT AS year, shoot_time[6:7]::INT AS month FROM photos)
        SELECT year, {_SEASON.format(m="month")} AS season, month, count(*) AS n FROM k GROUP BY ROLLUP (1, 2, 3)""",
    "time_tree": f"""WITH {PHOTOS_SQL}, a AS (SELECT album_id, max(shoot_time) AS t FROM photos GROUP BY 1), k AS (SELECT t[1:4]::INT AS year, t[6:7]::INT AS month, album_id FROM a)
        SELECT year, {_SEASON.format(m="month")} AS season, month, album_id, row_number() OVER (PARTITION BY year, month ORDER BY album_id) AS place FROM k""",
    "time_groups": f"""WITH {PHOTOS_SQL}, s AS (SELECT album_id, max(shoot_time)[1:7] AS ym FROM photos WHERE album_id % 3 > 0 GROUP BY 1),
        r AS (SELECT c_custkey AS album_id, coalesce(ym, CASE WHEN c_custkey % 5 > 0 THEN 1990 + c_custkey % 9 || '-' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') END) AS ym FROM customer LEFT JOIN s ON s.album_id = c_custkey),
        k AS (SELECT album_id, coalesce(ym[1:4]::INT, 0) AS year, ym[6:7]::INT AS month FROM r), n AS (SELECT *, CASE WHEN month IS NOT NULL THEN {_SEASON.format(m="month")} END AS season FROM k)
        SELECT album_id, year, season, month, dense_rank() OVER (PARTITION BY year ORDER BY latest DESC)::INT AS season_place FROM (SELECT *, max(month) OVER (PARTITION BY year, season) AS latest FROM n)""",
    "dense_month_bars": f"""WITH {PHOTOS_SQL}, d AS (SELECT m.month::INT AS month, count(id) AS n FROM range(1, 13) m(month)
        LEFT JOIN photos ON shoot_time[1:4] = '1996' AND shoot_time[6:7]::INT = m.month GROUP BY 1)
        SELECT month, n, round(n / (SELECT max(n) FROM d), 6) AS share FROM d""",
    "year_top5": f"WITH {PHOTOS_SQL} SELECT shoot_time[1:4] AS year, count(*) AS n FROM photos GROUP BY 1 ORDER BY n DESC, year LIMIT 5",
    "place_top5_ratio": f"""WITH {PHOTOS_SQL}, t AS (SELECT location, count(*) AS n FROM photos WHERE location IS NOT NULL GROUP BY 1 ORDER BY n DESC, location LIMIT 5)
        SELECT location, n, round(n / (SELECT max(n) FROM t), 6) AS ratio FROM t""",
    "cumulative_layout": f"""WITH {PHOTOS_SQL}, m AS (SELECT coalesce(shoot_time[1:7], '') AS ym, count(*) AS n FROM photos GROUP BY 1)
        SELECT ym, n, coalesce(sum(n) OVER w, 0)::BIGINT AS photos_before, count(*) OVER w AS months_before FROM m
        WINDOW w AS (ORDER BY ym DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
}
