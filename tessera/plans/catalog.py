"""Filtered lists, group counts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.filters import contains_any_case, newest_first, page, range_filter, smart_filter, SmartFilter, token_search
from tessera.operators.merge import delete_keys
from tessera.operators.numbering import numbered
from tessera.sources.tables import table
from tessera.sources.views import ALBUMS_SQL, PHOTOS_SQL, albums, photos


def q_smart_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = SmartFilter(keyword="urgent", date_from="1996-01-01", date_to="1997-12-31", location="_1", tone="F")
    return smart_filter(photos(spark, sf_dir), wanted, ["category", "path"]).select("id", "shoot_time", "location")


def q_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = range_filter(table(spark, sf_dir, "lineitem"), {"l_quantity": (10, 20), "l_discount": (0.05, None), "l_tax": (None, 0.04)})
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def smart_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of fifty of what a label and a person find, newest first: the feature is the page."""
    rows = photos(spark, sf_dir).withColumns({"label": F.concat_ws(" ", "tone", "category"), "person_ids": F.concat(F.lit('["P'), F.col("album_id") % 50, F.lit('"]'))})
    found = smart_filter(rows, SmartFilter(label="urgent", person_id='P7"', category=" "), ["path"])
    return page(found, newest_first(), 2, 50).select("id", "shoot_time")


def keyword_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(contains_any_case(F.col("text"), "heation")).select("doc_id", "source", "n_chars")


def token_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_search(table(spark, sf_dir, "documents"), "text", "thnd ñdo").select("doc_id")


def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).where(F.col("category") == "2-HIGH")
    return page(rows.select("id", "score"), [F.desc("score"), F.col("id")], 3, 40)


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).groupBy("category", "tone").agg(F.count("*").alias("n"))


def category_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover of each category, its row of greatest score, with the count; aggregation instead of a window, so no category is sorted."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "id", "path")).alias("b")
    return photos(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), best).select("category", "n", F.col("b.id").alias("cover_id"), F.col("b.path").alias("cover"))


def location_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).withColumn("place", F.coalesce(F.nullif(F.trim("location"), F.lit("")), F.lit("")))
    cover = F.min(F.struct((-F.coalesce("score", F.lit(-1.0))).alias("s"), "id")).alias("b")
    return rows.groupBy("place").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), cover).select(
        "place", "n", "mean_score", F.col("b.id").alias("cover_id")
    )


def keyword_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by event type with a row for all."""
    return table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("*")).alias("chip"), "n")


def album_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums by scan state and year of their latest photo, year 0 for those without."""
    latest = photos(spark, sf_dir).groupBy("album_id").agg(F.max("shoot_time").alias("t"), F.count("*").alias("c"))
    rows = albums(spark, sf_dir).join(latest, F.col("id") == F.col("album_id"), "left")
    state = F.when(F.col("c").isNull(), "unscanned").when(F.col("c") < 10, "partial").otherwise("scanned")
    return rows.groupBy(state.alias("state"), F.coalesce(F.substring("t", 1, 4).cast("int"), F.lit(0)).alias("year")).agg(F.count("*").alias("n"))


def album_location_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums of each place in order of name, a row each: a place of very many albums is no list in one row."""
    rows = numbered(albums(spark, sf_dir).select("location", "name"), ["location"], ["name"])
    return rows.select("location", "name", (F.col("place") + 1).alias("place"))


def known_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources known from documents, labels or events, each once."""
    docs, labels, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "events")
    ids = docs.select(F.col("doc_id").alias("id")).union(labels.select("doc_id")).union(events.select("user_id")).distinct()
    return ids.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


def set_difference_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents not labelled yet, plus those queued again."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    queued = labels.where("quality = 0").select("doc_id")
    return delete_keys(docs, labels, ["doc_id"]).union(docs.join(queued, "doc_id", "left_semi")).select("doc_id", "source")


def mark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks by state and how many still have their document."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id", F.lit(1).alias("alive"))
    state = F.when(F.col("toxic") == 1, "hidden").when(F.col("quality") == 0, "archived")
    return labels.withColumn("state", state).where("state is not null").join(docs, "doc_id", "left").groupBy("state").agg(F.count("*").alias("n"), F.count("alive").alias("n_alive"))


def distinct_person_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct event types of each user in order of first appearance."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda r: r["event_type"]), ",").alias("types"))


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven evenly spaced customers by key, both ends included: the feature is the sample."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    ranked = numbered(rows, [], ["c_custkey"], "i")
    n = rows.count()
    picks = sorted({int(i * (n - 1) / 6 + 0.5) for i in range(7)})
    return ranked.where(F.col("i").isin(picks)).select("c_custkey")


QUERIES = {"smart_filter": q_smart_filter, "range_filter": q_range_filter} | {
    f.__name__: f
    for f in (
        smart_search_page, keyword_like, token_prefix_search, paged_listing, category_counts, category_cover, location_summary, keyword_chips, album_facets,
        album_location_groups, known_union, set_difference_pending, mark_counts, distinct_person_photos, even_sample,
    )
}

ORACLES = {
    "smart_search_page": f"""WITH {PHOTOS_SQL} SELECT id, shoot_time FROM photos WHERE category ILIKE '%urgent%' AND album_id % 50 = 7 ORDER BY shoot_time DESC NULLS LAST, id DESC LIMIT 50 OFFSET 50""",
    "smart_filter": f"""WITH {PHOTOS_SQL} SELECT id, shoot_time, location FROM photos WHERE (category ILIKE '%urgent%' OR path ILIKE '%urgent%')
        AND shoot_time >= '1996-01-01' AND shoot_time <= '1997-12-31 23:59:59' AND location ILIKE '%_1%' AND tone = 'F'""",
    "range_filter": """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
        WHERE l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.05 AND l_tax <= 0.04 GROUP BY 1""",
    "keyword_like": "SELECT doc_id, source, n_chars FROM documents WHERE text ILIKE '%heation%'",
    "token_prefix_search": r"""SELECT doc_id FROM documents
        WHERE len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w = 'thnd' OR starts_with(w, 'ñdo'))) > 0""",
    "paged_listing": f"WITH {PHOTOS_SQL} SELECT id, score FROM photos WHERE category = '2-HIGH' ORDER BY score DESC, id LIMIT 40 OFFSET 80",
    "category_counts": f"WITH {PHOTOS_SQL} SELECT category, tone, count(*) AS n FROM photos GROUP BY 1, 2",
    "category_cover": f"""WITH {PHOTOS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY category) AS n FROM photos)
        SELECT category, n, id AS cover_id, path AS cover FROM r WHERE rn = 1""",
    "location_summary": f"""WITH {PHOTOS_SQL}, r AS (SELECT *, coalesce(nullif(trim(location), ''), '') AS place FROM photos)
        SELECT place, count(*) AS n, round(avg(score), 4) AS mean_score, arg_min(id, (-coalesce(score, -1.0), id)) AS cover_id FROM r GROUP BY 1""",
    "keyword_chips": "SELECT coalesce(event_type, '*') AS chip, count(*) AS n FROM events GROUP BY ROLLUP (event_type)",
    "album_facets": f"""WITH {PHOTOS_SQL}, {ALBUMS_SQL}, l AS (SELECT album_id, max(shoot_time) AS t, count(*) AS c FROM photos GROUP BY 1)
        SELECT CASE WHEN c IS NULL THEN 'unscanned' WHEN c < 10 THEN 'partial' ELSE 'scanned' END AS state, coalesce(t[1:4]::INT, 0) AS year, count(*) AS n
        FROM albums LEFT JOIN l ON id = album_id GROUP BY 1, 2""",
    "album_location_groups": f"WITH {ALBUMS_SQL} SELECT location, name, row_number() OVER (PARTITION BY location ORDER BY name) AS place FROM albums",
    "known_union": """SELECT count(*) AS n, min(id) AS low, max(id) AS high FROM (SELECT doc_id AS id FROM documents UNION SELECT doc_id FROM labels UNION SELECT user_id FROM events)""",
    "set_difference_pending": """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""",
    "mark_counts": """WITH m AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'hidden' WHEN quality = 0 THEN 'archived' END AS state FROM labels)
        SELECT state, count(*) AS n, count(d.doc_id) AS n_alive FROM m LEFT JOIN documents d ON d.doc_id = m.doc_id AND d.n_chars > 500 WHERE state IS NOT NULL GROUP BY 1""",
    "distinct_person_photos": """WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY 1, 2)
        SELECT user_id, string_agg(event_type, ',' ORDER BY f, event_type) AS types FROM f GROUP BY 1""",
    "even_sample": """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer)
        SELECT c_custkey FROM r WHERE i IN (SELECT floor(k * (n - 1) / 6 + 0.5)::BIGINT FROM range(7) x(k))""",
}
