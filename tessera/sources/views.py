"""Views of the generated tables in the terms of a media library.

An order stands for a photo: its date is the shooting time, its customer the
album, the customer's nation the place. A document stands for the recognised
content of a photo, an embedding for its image vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

#: The same view for SQL, as common table expressions.
PHOTOS_SQL = """photos AS (
  SELECT o_orderkey AS id, '/lib/' || coalesce(n_name, '?') || '/' || o_custkey || '/' || o_orderkey || '.jpg' AS path,
         o_custkey AS album_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shoot_time, n_name AS location,
         o_orderpriority AS category, o_orderstatus AS tone, o_totalprice AS score
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
ALBUMS_SQL = """albums AS (
  SELECT c_custkey AS id, c_name AS name, '/lib/' || n_name || '/' || c_custkey AS root, c_mktsegment AS kind, n_name AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    return (
        orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("/lib/"), F.coalesce("n_name", F.lit("?")), F.lit("/"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"), F.lit(".jpg")).alias("path"),
            F.col("o_custkey").alias("album_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("shoot_time"),
            F.col("n_name").alias("location"),
            F.col("o_orderpriority").alias("category"),
            F.col("o_orderstatus").alias("tone"),
            F.col("o_totalprice").alias("score"),
        )
    )


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("/lib/"), F.col("n_name"), F.lit("/"), F.col("c_custkey")).alias("root"),
        F.col("c_mktsegment").alias("kind"),
        F.col("n_name").alias("location"),
    )
