"""Streams and guarded SQL as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.clustering import non_maximum_suppression
from tessera.operators.sql_guard import run_guarded, table_counts
from tessera.sources.shared import shared_path
from tessera.sources.tables import table
from tessera.streaming.incremental import scan_incrementally, sessions, windowed_counts


def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream of files, each event stored once."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    target = shared_path(spark, "events")
    scan_incrementally(source, "event_id", target, shared_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts; on a table the watermark has no effect."""
    rows = windowed_counts(table(spark, sf_dir, "events"), "1 hour", "10 minutes")
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions(table(spark, sf_dir, "events"), "30 minutes", "10 minutes")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").withColumn("email", F.concat("c_name", F.lit("@x.example"))).createOrReplaceTempView("guard_customer")
    return run_guarded(spark, "select c_custkey, email, email as contact, c_mktsegment from guard_customer order by c_custkey", 25)


def listed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["region", "nation", "orders"]
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(f"listed_{n}")
    return table_counts(spark, [f"listed_{n}" for n in names])


def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made up from items, an order being the image."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    boxes = items.select(
        F.col("l_orderkey").cast("string").alias("image"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_linenumber").cast("double").alias("x1"), F.lit(0.0).alias("y1"),
        (F.col("l_linenumber") + 3.0).alias("x2"), F.lit(2.0).alias("y2"), (F.col("q") + F.col("d")).alias("score"),
    )
    return non_maximum_suppression(boxes, 0.45).groupBy("id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_incremental, event_windows, user_sessions, guarded_sql, listed_tables, box_suppression)}

ORACLES = {
    "stream_incremental": "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "user_sessions": """WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTES)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "guarded_sql": "SELECT c_custkey, '***' AS email, c_name[1:1] || '***@x.example' AS contact, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 25",
    "box_suppression": """WITH RECURSIVE b AS (SELECT l_orderkey AS image, l_linenumber AS id, max(l_quantity) + max(l_discount) AS score FROM lineitem GROUP BY 1, 2),
        o AS MATERIALIZED (SELECT image, id, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS k FROM b),
        r AS (SELECT image, k, [id] AS kept FROM o WHERE k = 1 UNION ALL
            SELECT o.image, o.k, CASE WHEN len(list_filter(kept, lambda e: 2.0 * greatest(0, 3 - abs(e - o.id)) > 0.45 * (12 - 2.0 * greatest(0, 3 - abs(e - o.id))))) > 0 THEN kept ELSE list_append(kept, o.id) END
            FROM r JOIN o ON o.image = r.image AND o.k = r.k + 1)
        SELECT id::BIGINT AS id, count(*) AS n FROM (SELECT unnest(kept) AS id FROM (SELECT kept FROM r QUALIFY row_number() OVER (PARTITION BY image ORDER BY k DESC) = 1)) GROUP BY 1""",
    "listed_tables": "SELECT 'listed_region' AS name, (SELECT count(*) FROM region) AS n UNION ALL SELECT 'listed_nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'listed_orders', (SELECT count(*) FROM orders)",
}
