"""Joins: cards, anti and semi joins, prefixes, health, folder trees, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.photo import coverage
from tessera.operators.prefixes import longest_owner, owners
from tessera.operators.spatial import grid_cell, locate
from tessera.sources.tables import table
from tessera.sources.views import ALBUMS_SQL, PHOTOS_SQL, albums, photos


def left_join_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with album name and a thumbnail, here the item of least line number; both may be missing."""
    thumbs = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_quantity > 25").select("l_orderkey", F.col("l_partkey").alias("thumb"))
    own = albums(spark, sf_dir).where("kind = 'BUILDING'").select(F.col("id").alias("aid"), "name")
    p = photos(spark, sf_dir)
    return p.join(own, p.album_id == own.aid, "left").join(thumbs, p.id == thumbs.l_orderkey, "left").select("id", "name", "thumb")


def anti_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums without an urgent photo."""
    return albums(spark, sf_dir).join(photos(spark, sf_dir).where("category = '1-URGENT'").select(F.col("album_id").alias("id")), "id", "left_anti").select("id", "name")


def semi_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums of a segment or with an urgent photo of great score."""
    rich = photos(spark, sf_dir).where("category = '1-URGENT' and score > 350000").select(F.col("album_id").alias("id")).distinct()
    rows = albums(spark, sf_dir)
    by_kind = rows.where("kind = 'MACHINERY'").select("id")
    return by_kind.union(rows.join(rich, "id", "left_semi").select("id")).distinct()


def four_way_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their photo, part and supplier's nation, the best twenty of one brand."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    part = table(spark, sf_dir, "part").where("p_brand = 'Brand#2'").select("p_partkey", "p_name")
    supplier, nation = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    joined = (
        item.join(part, item.l_partkey == part.p_partkey)
        .join(orders, item.l_orderkey == orders.o_orderkey, "left")
        .join(supplier, item.l_suppkey == supplier.s_suppkey, "left")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    )
    return joined.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", "p_name", "o_orderstatus", "n_name")


def priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label the row of the first source that knows it: documents, else pages."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 1500").select(F.col("doc_id").alias("id"), F.lit(0).alias("prio"), F.col("source").alias("origin"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit(1).alias("prio"), F.lit("page").alias("origin"))
    known = docs.unionByName(pages).groupBy("id").agg(F.min(F.struct("prio", "origin")).alias("b"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return labels.join(known, "id", "left").select("id", F.col("b.origin").alias("origin"))


def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos below each album root and below each nation root; nested roots both count."""
    own = albums(spark, sf_dir).select("id", "root")
    nations = table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.concat(F.lit("/lib/"), F.col("n_name")).alias("root"))
    return owners(photos(spark, sf_dir).select("id", "path"), own.union(nations)).groupBy("root").agg(F.count("*").alias("n"))


def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = albums(spark, sf_dir).select("id", "root")
    nations = table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.concat(F.lit("/lib/"), F.col("n_name")).alias("root"))
    return longest_owner(photos(spark, sf_dir).select("id", "path"), own.union(nations)).select("id", "owner_id")


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and worst level of each album: photos on disk are items, scanned ones orders, embedded ones urgent orders."""
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    disk = items.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("on_disk"))
    scanned = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("scanned"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("embedded"))
    rows = albums(spark, sf_dir).select("id").join(disk, "id", "left").join(scanned, "id", "left").na.fill(0)
    level = (
        F.when((F.col("on_disk") == 0) & (F.col("scanned") == 0), "ok")
        .when(F.col("scanned") == 0, "bad")
        .when(F.col("scanned") < F.col("on_disk") * 0.2, "warn")
        .when(F.col("embedded") == 0, "warn")
        .otherwise("ok")
    )
    ratio = F.round(coverage(F.col("scanned"), F.col("on_disk")), 6)
    return rows.select("id", "on_disk", "scanned", F.greatest(F.lit(0), F.col("on_disk") - F.col("scanned")).alias("gap"), ratio.alias("coverage"), level.alias("level"))


def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = health_report(spark, sf_dir)
    return rows.groupBy("level").agg(F.count("*").alias("albums"), F.sum("on_disk").alias("on_disk"), F.sum("scanned").alias("scanned"))


def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five photos of each place: the feature is the sample of a health report."""
    order = Window.partitionBy("location").orderBy("id")
    return photos(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n <= 5").select("location", "n", "id")


def folder_paths_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full paths of a tree of regions, nations and segments, level by level up to the greatest allowed depth."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    segments = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    nodes = (
        region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
        .union(nation.select(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")), "n_name"))
        .union(segments.select(F.concat(F.lit("s"), F.col("c_nationkey"), F.col("c_mktsegment")), F.concat(F.lit("n"), F.col("c_nationkey")), "c_mktsegment"))
    )
    level = nodes.where("parent is null").select("id", F.col("name").alias("path"), F.lit(1).alias("level"))
    tree = level
    for depth in (2, 3):
        children = nodes.select(F.col("id").alias("cid"), "parent", "name").join(level, F.col("parent") == F.col("id"))
        level = children.select(F.col("cid").alias("id"), F.concat_ws("/", "path", "name").alias("path"), F.lit(depth).alias("level"))
        tree = tree.union(level)
    return tree


def ancestor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums whose own name, nation or region matches a word."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    rows = albums(spark, sf_dir).join(places, F.col("location") == F.col("n_name"))
    return rows.where(F.col("r_name").ilike("%asia%") | F.col("n_name").ilike("%\\_12%") | F.col("name").ilike("%0099%")).select("id", "name")


def _coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at made-up coordinates between 0 and 10 degrees."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("id"), ((key * 37) % 1000 / 100.0).alias("lon"), ((key * 91) % 997 / 100.0).alias("lat"))


def grid_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest cells of a tenth of a degree, greatest cell first on ties."""
    cells = _coordinates(spark, sf_dir).groupBy(grid_cell(F.col("lat"), F.col("lon"), 1).alias("cell")).agg(F.count("*").alias("n"))
    return cells.select("cell.y", "cell.x", "n").orderBy(F.desc("n"), F.desc("y"), F.desc("x")).limit(10)


def _regions(spark: SparkSession) -> DataFrame:
    def ring(points: list[tuple[float, float]]) -> list[dict]:
        return [{"lon": float(x), "lat": float(y)} for x, y in points]

    square = [[ring([(1, 1), (6, 1), (6, 6), (1, 6)]), ring([(2, 2), (4, 2), (4, 4), (2, 4)])]]
    triangle = [[ring([(6, 6), (9.5, 6), (6, 9.5)])]]
    rows = [(1, "square with a hole", [1.0, 1.0, 6.0, 6.0], square), (2, "triangle", [6.0, 6.0, 9.5, 9.5], triangle)]
    return spark.createDataFrame(rows, "id int, name string, bbox array<double>, polygons array<array<array<struct<lon:double,lat:double>>>>")


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate(_coordinates(spark, sf_dir), _regions(spark)).groupBy("region_id").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


QUERIES = {
    f.__name__: f
    for f in (
        left_join_cards, anti_unmarked, semi_tagged, four_way_hits, priority_lookup, prefix_counts, longest_prefix, health_report, health_summary,
        first_samples, folder_paths_recursive, ancestor_search, grid_mode, point_in_polygon,
    )
}

_ROOTS = "roots AS (SELECT id, root FROM albums UNION ALL SELECT -n_nationkey - 1, '/lib/' || n_name FROM nation)"
_HEALTH = f"""WITH {ALBUMS_SQL}, d AS (SELECT o_custkey AS id, count(*) AS on_disk FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    s AS (SELECT o_custkey AS id, count(*) AS scanned, count(*) FILTER (o_orderpriority = '1-URGENT') AS embedded FROM orders GROUP BY 1),
    r AS (SELECT albums.id, coalesce(on_disk, 0) AS on_disk, coalesce(scanned, 0) AS scanned, coalesce(embedded, 0) AS embedded FROM albums LEFT JOIN d USING (id) LEFT JOIN s USING (id)),
    h AS (SELECT id, on_disk, scanned, greatest(0, on_disk - scanned) AS gap, CASE WHEN on_disk <= 0 THEN 0.0 ELSE round(least(1.0, greatest(0.0, scanned / on_disk)), 6) END::DOUBLE AS coverage,
        CASE WHEN on_disk = 0 AND scanned = 0 THEN 'ok' WHEN scanned = 0 THEN 'bad' WHEN scanned < on_disk * 0.2 THEN 'warn' WHEN embedded = 0 THEN 'warn' ELSE 'ok' END AS level FROM r)"""
_XY = "xy AS (SELECT o_orderkey AS id, (o_orderkey * 37) % 1000 / 100.0::DOUBLE AS lon, (o_orderkey * 91) % 997 / 100.0::DOUBLE AS lat FROM orders)"
ORACLES = {
    "left_join_cards": f"""WITH {PHOTOS_SQL}, {ALBUMS_SQL} SELECT photos.id, albums.name, l_partkey AS thumb FROM photos
        LEFT JOIN albums ON album_id = albums.id AND kind = 'BUILDING' LEFT JOIN lineitem ON photos.id = l_orderkey AND l_linenumber = 1 AND l_quantity > 25""",
    "anti_unmarked": f"WITH {ALBUMS_SQL} SELECT id, name FROM albums WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "semi_tagged": f"""WITH {ALBUMS_SQL} SELECT id FROM albums WHERE kind = 'MACHINERY'
        UNION SELECT id FROM albums WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 350000)""",
    "four_way_hits": """SELECT l_orderkey, l_linenumber, p_name, o_orderstatus, n_name FROM lineitem JOIN part ON l_partkey = p_partkey AND p_brand = 'Brand#2'
        LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20""",
    "priority_lookup": """SELECT l.doc_id AS id, CASE WHEN d.doc_id IS NOT NULL THEN d.source WHEN p.page_id IS NOT NULL THEN 'page' END AS origin
        FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.n_chars > 1500 LEFT JOIN pages p ON l.doc_id = p.page_id""",
    "prefix_counts": f"""WITH {PHOTOS_SQL}, {ALBUMS_SQL}, {_ROOTS} SELECT root, count(*) AS n FROM photos JOIN roots ON starts_with(path, root || '/') GROUP BY 1""",
    "longest_prefix": f"""WITH {PHOTOS_SQL}, {ALBUMS_SQL}, {_ROOTS}
        SELECT photos.id, arg_max(roots.id, length(root)) AS owner_id FROM photos LEFT JOIN roots ON starts_with(path, root || '/') GROUP BY 1""",
    "health_report": f"{_HEALTH} SELECT * FROM h",
    "health_summary": f"{_HEALTH} SELECT level, count(*) AS albums, sum(on_disk)::BIGINT AS on_disk, sum(scanned)::BIGINT AS scanned FROM h GROUP BY 1",
    "first_samples": f"WITH {PHOTOS_SQL} SELECT location, n, id FROM (SELECT location, id, row_number() OVER (PARTITION BY location ORDER BY id) AS n FROM photos) WHERE n <= 5",
    "folder_paths_recursive": """WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region
          UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
          UNION ALL SELECT DISTINCT 's' || c_nationkey || c_mktsegment, 'n' || c_nationkey, c_mktsegment FROM customer),
        t AS (SELECT id, name AS path, 1 AS level FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, t.path || '/' || n.name, t.level + 1 FROM nodes n JOIN t ON n.parent = t.id)
        SELECT id, path, level FROM t""",
    "ancestor_search": f"""WITH {ALBUMS_SQL} SELECT albums.id, albums.name FROM albums JOIN nation ON location = n_name JOIN region ON n_regionkey = r_regionkey
        WHERE r_name ILIKE '%asia%' OR n_name LIKE '%\\_12%' ESCAPE '\\' OR name ILIKE '%0099%'""",
    "grid_mode": f"""WITH {_XY} SELECT round(lat)::INT AS y, round(lon)::INT AS x, count(*) AS n FROM xy GROUP BY 1, 2 ORDER BY n DESC, y DESC, x DESC LIMIT 10""",
    "point_in_polygon": f"""WITH {_XY}, e(rid, ring, x1, y1, x2, y2) AS (VALUES
          (1, 0, 1, 1, 6, 1), (1, 0, 6, 1, 6, 6), (1, 0, 6, 6, 1, 6), (1, 0, 1, 6, 1, 1), (1, 1, 2, 2, 4, 2), (1, 1, 4, 2, 4, 4), (1, 1, 4, 4, 2, 4), (1, 1, 2, 4, 2, 2),
          (2, 0, 6, 6, 9.5, 6), (2, 0, 9.5, 6, 6, 9.5), (2, 0, 6, 9.5, 6, 6)),
        c AS (SELECT id, rid, count(*) % 2 AS odd FROM xy JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2),
        h AS (SELECT xy.id, min(rid) AS region_id FROM xy LEFT JOIN c ON xy.id = c.id AND odd = 1 GROUP BY 1)
        SELECT region_id, count(*) AS n, min(id) AS low, max(id) AS high FROM h GROUP BY 1""",
}
