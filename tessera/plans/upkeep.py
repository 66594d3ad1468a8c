"""Tables that are kept up: scans at their own pace, results by signature, moved paths, persons across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.clustering import FaceRegistry
from tessera.operators.export import unique_names
from tessera.operators.moves import Held, deleted_everywhere, moved_everywhere
from tessera.plans import timeline, vectors
from tessera.sources.folders import tailed, tree
from tessera.sources.kept import Kept, signature
from tessera.sources.shared import shared_path
from tessera.sources.tables import table
from tessera.sources.views import photos
from tessera.streaming.scan_table import ScanTable

LEGS = {"ai": ["label", "score"], "exif": ["place"]}


def scanned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of three scans of their customer, read as a stream, then once more after the checkpoint was lost, with a merge in between."""
    schema = table(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/orders.parquet*")
    k = F.col("o_orderkey")
    changes = orders.select(
        F.col("o_custkey").alias("album"), k.cast("long").alias("version"), (k % 11 == 0).alias("deleted"), (k % 3 == 0).alias("ai"), (k % 2 == 0).alias("exif"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("label"), F.when(k % 7 != 0, F.col("o_totalprice").cast("double")).alias("score"), F.when(k % 4 != 1, F.col("o_orderstatus")).alias("place"),
    )
    scans = ScanTable(spark, shared_path(spark, "scans"), "album", LEGS)
    scans.follow(changes, shared_path(spark, "offsets")).awaitTermination()
    scans.compact()
    scans.follow(changes, shared_path(spark, "offsets")).awaitTermination()
    return scans.rows()


def overview_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview, built for the signature of its tables and read back on the second call."""
    kept = Kept(spark, shared_path(spark, "overview"))
    made_for = signature({"orders": (table(spark, sf_dir, "orders"), "o_orderkey"), "customer": (table(spark, sf_dir, "customer"), "c_custkey")}, "day:06-15")
    kept.get(made_for, lambda: timeline.overview_scalar(spark, sf_dir))
    return kept.get(made_for, lambda: spark.range(1).select(F.raise_error(F.lit("built twice"))))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order moves what lies at one of a thousand paths to another."""
    k = F.col("o_orderkey")
    path = lambda n: F.concat(F.lit("/d"), n % 7, F.lit("/f"), n)
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(k.alias("seq"), path(k % 1000).alias("old_path"), path(k * 7 % 1000).alias("new_path"), (k % 10).alias("album_id"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 1000
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("/d"), n % 7, F.lit("/f"), n).alias("path"), F.lit("before").alias("dir"), F.lit(-1).cast("long").alias("album_id"))


def moved_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where photos lie after all moves, with the folder and album of the last."""
    return moved_everywhere({"photos": Held(_placed(spark, sf_dir), "path", "dir", "album_id")}, _moves(spark, sf_dir))["photos"]


def moved_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings by path, one a path: of those that meet the one that moved last stays; then the paths of every tenth supplier are deleted."""
    ratings = _placed(spark, sf_dir).groupBy("path").agg(F.min("id").alias("rating"))
    moved = moved_everywhere({"ratings": Held(ratings, key=("path",))}, _moves(spark, sf_dir))["ratings"]
    s = F.col("s_suppkey") * 10 % 1000
    gone = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/d"), s % 7, F.lit("/f"), s).alias("path"))
    return deleted_everywhere({"ratings": Held(moved)}, gone)["ratings"]


def resumed_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces in three runs, each of which goes on from the persons of the one before: as one sequence."""
    faces = vectors.label_faces(spark, sf_dir)
    registry = FaceRegistry(spark, shared_path(spark, "persons"), 0.2)
    most = faces.agg(F.max("id")).first()[0] or 0
    runs = [registry.register(faces.where((F.col("id") * 3 >= i * most) & ((F.col("id") * 3 < (i + 1) * most) | F.lit(i == 2)))) for i in range(3)]
    return runs[0].union(runs[1]).union(runs[2]).select("owner", "id", "person", F.round("sim", 6).alias("sim"))


def export_names_clashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for a flat export where the name of one photo is the numbered name of others."""
    n, d = F.col("id") % 13, F.col("id") % 10
    name = F.concat(F.lit("IMG"), d, F.when(n < 3, F.concat(F.lit("_"), n + 1)).when(n == 3, F.concat(F.lit("_"), d + 1, F.lit("_1"))).otherwise(""), F.lit(".jpg"))
    rows = photos(spark, sf_dir).select("id", F.concat(F.lit("/x/"), F.lpad(F.col("id").cast("string"), 12, "0"), F.lit("/"), name).alias("path"))
    return unique_names(rows, spark.createDataFrame([("IMG3.jpg",), ("IMG4_2.jpg",)], "name string")).select("id", "path", "target")


def tailed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of all documents followed in two runs, the second after more was written."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "doc_id", "lang", "source").alias("line"))
    logs, out, offsets = (shared_path(spark, n) for n in ("logs", "tailed", "offsets"))
    for part in ("doc_id % 3 = 0", "doc_id % 3 <> 0"):
        lines.where(part).select("line").write.mode("append").text(logs)
        stream = tailed(spark, logs, ".txt", piece=1 << 16)
        stream.writeStream.format("parquet").option("checkpointLocation", offsets).trigger(availableNow=True).start(out).awaitTermination()
    words = F.split("line", " ")
    return spark.read.parquet(out).groupBy(F.get(words, F.lit(1)).alias("lang"), F.get(words, F.lit(2)).alias("source")).agg(F.count("*").alias("n"), F.max(F.get(words, F.lit(0)).cast("long")).alias("last"))


def listed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as one file for each language and source, then listed: the folders, their files and whether any is empty."""
    at = shared_path(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.col("doc_id").cast("string").alias("line"))
    docs.repartition("lang", "source").write.partitionBy("lang", "source").text(at)
    files = tree(spark, at, levels=1).where("name like 'part-%'")
    return files.groupBy(F.regexp_extract("dir", "(lang=[^/]*/source=[^/]*)$", 1).alias("folder")).agg(F.count("*").alias("files"), F.min(F.col("size") > 0).alias("filled"))


QUERIES = {f.__name__: f for f in (tailed_lines, listed_folders, scanned_table, overview_kept, moved_tables, moved_ratings, resumed_clustering, export_names_clashing)}

_PATH = "'/d' || ({n}) % 7 || '/f' || ({n})"
_CHAIN = f"""m AS (SELECT o_orderkey AS seq, {_PATH.format(n="o_orderkey % 1000")} AS old, {_PATH.format(n="o_orderkey * 7 % 1000")} AS new, o_orderkey % 10 AS album FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 1000 <> o_orderkey * 7 % 1000),
  nxt AS (SELECT a.seq, min(b.seq) AS n FROM m a LEFT JOIN m b ON b.old = a.new AND b.seq > a.seq GROUP BY 1),
  p AS (SELECT c_custkey AS id, {_PATH.format(n="c_custkey % 1000")} AS path FROM customer),
  r AS (SELECT id, min(seq) AS seq FROM p JOIN m ON p.path = m.old GROUP BY id UNION ALL SELECT id, n FROM r JOIN nxt USING (seq) WHERE n IS NOT NULL),
  w AS (SELECT p.id, p.path AS old_path, l.seq, coalesce(m.new, p.path) AS path, m.album FROM p LEFT JOIN (SELECT id, max(seq) AS seq FROM r GROUP BY 1) l USING (id) LEFT JOIN m ON m.seq = l.seq)"""
ORACLES = {
    "tailed_lines": "SELECT lang, source, count(*) AS n, max(doc_id) AS last FROM documents GROUP BY 1, 2",
    "listed_folders": "SELECT DISTINCT 'lang=' || lang || '/source=' || source AS folder, 1::BIGINT AS files, true AS filled FROM documents",
    "scanned_table": """WITH c AS (SELECT o_custkey AS album, o_orderkey AS version, o_orderkey % 11 = 0 AS deleted, o_orderkey % 3 = 0 AS ai, o_orderkey % 2 = 0 AS exif,
          CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS label, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DOUBLE END AS score, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderstatus END AS place FROM orders),
        a AS (SELECT c.* FROM c WHERE NOT deleted AND version > coalesce((SELECT max(d.version) FROM c d WHERE d.deleted AND d.album = c.album), -1))
        SELECT album, max(version)::BIGINT AS version, (list(label ORDER BY version DESC) FILTER (ai OR label IS NOT NULL))[1] AS label, (list(score ORDER BY version DESC) FILTER (ai OR score IS NOT NULL))[1] AS score,
          (list(place ORDER BY version DESC) FILTER (exif OR place IS NOT NULL))[1] AS place FROM a GROUP BY album""",
    "overview_kept": timeline.ORACLES["overview_scalar"],
    "moved_tables": f"WITH RECURSIVE {_CHAIN} SELECT id, path, CASE WHEN seq IS NULL THEN 'before' ELSE regexp_extract(path, '^(.*)/', 1) END AS dir, coalesce(album, -1) AS album_id FROM w",
    "moved_ratings": f"""WITH RECURSIVE {_CHAIN}, o AS (SELECT old_path, min(id) AS rating, any_value(path) AS path, any_value(seq) AS seq FROM w GROUP BY 1),
        k AS (SELECT path, rating FROM o QUALIFY row_number() OVER (PARTITION BY path ORDER BY coalesce(seq, -1) DESC, rating DESC) = 1)
        SELECT path, rating FROM k WHERE path NOT IN (SELECT {_PATH.format(n="s_suppkey * 10 % 1000")} FROM supplier)""",
    "resumed_clustering": vectors.ORACLES["online_clustering"],
}
