"""Exports, reports and maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.export import bar_percents, organised, unique_names
from tessera.operators.merge import delete_keys
from tessera.operators.numbering import numbered
from tessera.operators.spatial import grid_cell
from tessera.sources.tables import table
from tessera.sources.views import PHOTOS_SQL, photos


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for a flat export of photos whose file name is the last digit of the key and a half of taken names."""
    rows = photos(spark, sf_dir).select("id", F.concat(F.lit("/x/"), F.col("id"), F.lit("/IMG"), F.col("id") % 10, F.lit(".jpg")).alias("path"))
    taken = spark.createDataFrame([(f"IMG{i}.jpg",) for i in range(5)], "name string")
    return unique_names(rows, taken).select("id", "target")


def organise_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).withColumn("shoot_time", F.when(F.col("tone") != "P", F.col("shoot_time")))
    return organised(rows).groupBy("folder").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def year_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = photos(spark, sf_dir).groupBy(F.substring("shoot_time", 1, 4).alias("year")).agg(F.count("*").cast("double").alias("n"))
    ends = years.agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return years.crossJoin(ends).select("year", F.round(bar_percents(F.col("n"), F.col("low"), F.col("high")), 6).alias("height"))


def cell_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each photo with the representative of its cell, so that a place is looked up once a cell."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 37 % 1000 / 100.0).alias("lon"), (F.col("o_orderkey") * 91 % 997 / 100.0).alias("lat"))
    keyed = rows.withColumn("cell", grid_cell(F.col("lat"), F.col("lon"), 1))
    first = keyed.groupBy("cell").agg(F.min("id").alias("representative"))
    return keyed.join(first, "cell").select("id", "representative")


def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose document is gone lose their link; counted by state."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    alive = table(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id", F.col("doc_id").alias("link"))
    return labels.join(alive, "doc_id", "left").groupBy(F.col("link").isNull().alias("dropped")).agg(F.count("*").alias("n"))


def next_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next customer name after the greatest number in use, and next order within each segment."""
    c = table(spark, sf_dir, "customer")
    number = F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("long")
    return c.groupBy("c_mktsegment").agg((F.coalesce(F.max(number), F.lit(-1)) + 1).alias("next")).select("c_mktsegment", F.format_string("P%03d", "next").alias("next_id"))


def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of documents by source with the distinct issues in the order of their first document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    verdict = F.when(F.col("quality").isNull(), "unknown").when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").otherwise("fail")
    marked = rows.withColumn("verdict", verdict)
    issues = marked.where("verdict = 'fail'").groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    listed = issues.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "lang"))), lambda r: r["lang"]), ",").alias("issues"))
    counts = marked.groupBy("source").agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("pass", "fail", "unknown")))
    return counts.join(listed, "source", "left")


def accuracy_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the language of a document is the commonest of its source."""
    docs = table(spark, sf_dir, "documents")
    common = docs.groupBy("source", "lang").agg(F.count("*").alias("c")).groupBy("source").agg(F.min(F.struct((-F.col("c")).alias("c"), "lang")).alias("b")).select("source", F.col("b.lang").alias("guess"))
    return docs.join(common, "source").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("lang") == F.col("guess")).cast("double")), 6).alias("accuracy"))


def interpolated_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear percentiles of values by type; the groups are five and their values are summed per distinct value."""
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(p.alias("p"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return rows.select("event_type", *(F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))), F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"))


def throttled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and every thirtieth part of the customers in key order: the lines that a long job logs."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    n = rows.count()
    step = max(1, -(-n // 30))
    ranked = numbered(rows, [], ["c_custkey"]).withColumn("i", F.col("place") + 1)
    return ranked.where((F.col("i") == 1) | (F.col("i") == n) | (F.col("i") % step == 0)).select("c_custkey")


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in 256 bins of item prices, as of the brightness of pixels, with the weighted mean."""
    item = table(spark, sf_dir, "lineitem").select(F.least(F.lit(255), F.floor(F.col("l_extendedprice") / 400)).cast("int").alias("bin"))
    return item.groupBy("bin").agg(F.count("*").alias("n"))


def text_index_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of benchmark items that no document equals: what an encoder has to be asked for."""
    items = table(spark, sf_dir, "benchmark").select("text").distinct()
    return delete_keys(items, table(spark, sf_dir, "documents"), ["text"]).agg(F.count("*").alias("n"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation, who opens it and characters by role."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.min(F.struct("turn", "role")).getField("role").alias("opened_by"),
        F.coalesce(F.sum(F.when(F.col("role") == "user", F.char_length("text"))), F.lit(0)).alias("user_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        export_names, organise_plan, year_bars, cell_fanout, dead_links, next_numbers, qc_summary, accuracy_by_class, interpolated_percentiles, throttled_rows, value_histogram,
        text_index_misses, conversation_turns,
    )
}

ORACLES = {
    "export_names": """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 10 AS d, '/x/' || o_orderkey || '/IMG' AS p FROM orders),
        i AS (SELECT id, d, row_number() OVER (PARTITION BY d ORDER BY p || d || '.jpg') - 1 + (d < 5)::INT AS i FROM r) SELECT id, CASE WHEN i = 0 THEN 'IMG' || d || '.jpg' ELSE 'IMG' || d || '_' || i || '.jpg' END AS target FROM i""",
    "organise_plan": f"""WITH {PHOTOS_SQL} SELECT CASE WHEN tone <> 'P' THEN shoot_time[1:4] ELSE 'unknown-year' END || '/' || coalesce(location, 'unknown-place') AS folder, count(*) AS n, min(id) AS first_id FROM photos GROUP BY 1""",
    "year_bars": f"""WITH {PHOTOS_SQL}, y AS (SELECT shoot_time[1:4] AS year, count(*)::DOUBLE AS n FROM photos GROUP BY 1)
        SELECT year, round(8 + 92 * (n - (SELECT min(n) FROM y)) / ((SELECT max(n) FROM y) - (SELECT min(n) FROM y)), 6) AS height FROM y""",
    "cell_fanout": """WITH r AS (SELECT o_orderkey AS id, round(o_orderkey * 91 % 997 / 100.0::DOUBLE) AS y, round(o_orderkey * 37 % 1000 / 100.0::DOUBLE) AS x FROM orders) SELECT id, min(id) OVER (PARTITION BY y, x) AS representative FROM r""",
    "dead_links": "SELECT d.doc_id IS NULL AS dropped, count(*) AS n FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.n_chars > 1000 GROUP BY 1",
    "next_numbers": "SELECT c_mktsegment, 'P' || CASE WHEN m < 1000 THEN lpad(m::VARCHAR, 3, '0') ELSE m::VARCHAR END AS next_id FROM (SELECT c_mktsegment, max(regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT) + 1 AS m FROM customer GROUP BY 1)",
    "qc_summary": """WITH r AS (SELECT d.*, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 AND toxic = 0 THEN 'pass' ELSE 'fail' END AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
        i AS (SELECT source, lang, min(doc_id) AS f FROM r WHERE v = 'fail' GROUP BY 1, 2), s AS (SELECT source, string_agg(lang, ',' ORDER BY f, lang) AS issues FROM i GROUP BY 1),
        c AS (SELECT source, count(*) FILTER (v = 'pass') AS n_pass, count(*) FILTER (v = 'fail') AS n_fail, count(*) FILTER (v = 'unknown') AS n_unknown FROM r GROUP BY 1) SELECT c.*, issues FROM c LEFT JOIN s ON c.source = s.source""",
    "accuracy_by_class": """WITH g AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY 1, 2), b AS (SELECT source, lang AS guess FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, lang) = 1)
        SELECT lang, count(*) AS n, round(avg((lang = guess)::INT), 6) AS accuracy FROM documents JOIN b USING (source) GROUP BY 1""",
    "interpolated_percentiles": """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1""",
    "throttled_rows": """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM r WHERE i = 1 OR i = n OR i % greatest(1, ceil(n / 30)::INT) = 0""",
    "value_histogram": "SELECT least(255, floor(l_extendedprice / 400))::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "text_index_misses": "SELECT count(*) AS n FROM (SELECT DISTINCT text FROM benchmark) WHERE text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL)",
    "conversation_turns": """SELECT conv_id, count(*) AS turns, arg_min(role, (turn, role)) AS opened_by, coalesce(sum(CASE WHEN role = 'user' THEN length(text) END), 0)::BIGINT AS user_chars FROM conversations GROUP BY 1""",
}
