"""Merges: ownership upserts, inserts, replacements, deletions, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalised_tags
from tessera.operators.merge import delete_keys, edit_array, insert_or_ignore, move_path, renumbered, replace_slice, upsert, upsert_owned
from tessera.sources.tables import table
from tessera.sources.views import PHOTOS_SQL, photos


def upsert_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows from orders, new ones from the items of line 1; which group a row owns follows from its key."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("price")
    )
    new = orders.where("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("label"),
        F.when(F.col("o_orderkey") % 7 > 0, F.lit(1.0)).alias("price"),
        (F.col("o_orderkey") % 8 == 0).alias("owns_ai"),
        (F.col("o_orderkey") % 6 == 0).alias("owns_exif"),
    )
    return upsert_owned(old, new, "id", {"owns_ai": ["label"], "owns_exif": ["price"]})


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return upsert(old, new, ["c_custkey"])


def insert_or_ignore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    new = table(spark, sf_dir, "documents").where("n_chars < 600").select("doc_id", F.lit(9).alias("quality"))
    return insert_or_ignore(old, new, ["doc_id"])


def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    new = old.where("event_type = 'click' and value > 50").withColumn("value", F.lit(0.0))
    return replace_slice(old, new, "event_type", "click")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items left after the albums of one segment went with their photos."""
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = delete_keys(table(spark, sf_dir, "orders"), gone, ["o_custkey"])
    removed = delete_keys(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), orders.select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])
    items = delete_keys(table(spark, sf_dir, "lineitem"), removed, ["l_orderkey"])
    return items.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


def path_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir).select("id", "path")
    moves = rows.where("id % 50 = 0").select(F.col("path").alias("old_path"), F.concat(F.lit("/archive/"), F.col("id")).alias("new_path"))
    return move_path(rows, moves)


def array_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("ids"))
    members, size = edit_array("ids", add="P001", remove="en")
    return rows.select("doc_id", F.array_join(members, ",").alias("ids"), size.cast("int").alias("n"))


def tag_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.split(F.concat_ws(",", F.lit(" a "), "lang", "source", F.lit("a"), F.lit(""), "lang"), ",")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(normalised_tags(tags), ",").alias("tags"))


def renumber_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region after nation 7 moved to the front of its siblings."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_nationkey").alias("sort_order"))
    return renumbered(rows, "n_regionkey", "sort_order", 7, 0, "n_nationkey")


QUERIES = {
    f.__name__: f
    for f in (upsert_ownership, upsert_rows, insert_or_ignore_rows, replace_partition, delete_cascade, path_move, array_add_remove, tag_normalise, renumber_siblings)
}

ORACLES = {
    "upsert_ownership": """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS label, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 3 <> 0),
        n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS label, CASE WHEN o_orderkey % 7 > 0 THEN 1.0::DOUBLE END AS price, o_orderkey % 8 = 0 AS ai, o_orderkey % 6 = 0 AS ex FROM orders WHERE o_orderkey % 2 = 0)
        SELECT coalesce(o.id, n.id) AS id, CASE WHEN coalesce(ai, false) THEN n.label ELSE coalesce(n.label, o.label) END AS label, CASE WHEN coalesce(ex, false) THEN n.price ELSE coalesce(n.price, o.price) END AS price
        FROM o FULL JOIN n ON o.id = n.id""",
    "upsert_rows": """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier""",
    "insert_or_ignore_rows": """SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 9 FROM documents WHERE n_chars < 600 AND doc_id NOT IN (SELECT doc_id FROM labels)""",
    "replace_partition": """SELECT event_type, event_id, value FROM events WHERE event_type IS DISTINCT FROM 'click' UNION ALL SELECT event_type, event_id, 0.0 FROM events WHERE event_type = 'click' AND value > 50""",
    "delete_cascade": """SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY 1""",
    "path_move": f"WITH {PHOTOS_SQL} SELECT id, CASE WHEN id % 50 = 0 THEN '/archive/' || id ELSE path END AS path FROM photos",
    "array_add_remove": """SELECT doc_id, array_to_string(list_filter([lang, source], lambda x: x <> 'en') || ['P001'], ',') AS ids, len(list_filter([lang, source], lambda x: x <> 'en') || ['P001'])::INT AS n FROM documents""",
    "tag_normalise": "SELECT doc_id, 'a,' || lang || ',' || source AS tags FROM documents",
    "renumber_siblings": """SELECT n_nationkey, n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_nationkey = 7 THEN -1 ELSE n_nationkey END) - 1)::INT AS sort_order FROM nation""",
}
