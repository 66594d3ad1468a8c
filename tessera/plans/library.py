"""Albums, folders, persons and scan reports over the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scans
from tessera.functions.text import fnv1a
from tessera.operators import albums as ops
from tessera.operators import people
from tessera.operators.prefixes import owners_any_case
from tessera.operators.trees import below
from tessera.plans.scalars import FNV_SQL
from tessera.sources.tables import table
from tessera.sources.views import ALBUMS_SQL, PHOTOS_SQL, albums, photos

MARK = "CASE WHEN toxic = 1 THEN 'hidden' WHEN quality = 0 THEN 'archived' END"


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a face: its user the person, its type the folder."""
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("/lib/"), "event_type", F.lit("/"), F.col("event_id") % 500, F.lit(".jpg"))
    return e.select(F.col("event_id").alias("face_id"), F.concat(F.lit("P"), "user_id").alias("person_id"), path.alias("path"), (F.col("event_id") % 7).cast("string").alias("box"), "value")


FACES_SQL = """faces AS (SELECT event_id AS face_id, 'P' || user_id AS person_id, '/lib/' || event_type || '/' || event_id % 500 || '.jpg' AS path, (event_id % 7)::VARCHAR AS box, value FROM events)"""


def virtual_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third supplier has an album for what is hidden, all get both virtual ones."""
    users = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    old = users.where("user_id % 3 = 0").select("user_id", F.lit("hidden").alias("kind"), F.lit("mine").alias("name"))
    out = ops.with_virtual_albums(old, users)
    return out.withColumn("virtual", ops.is_virtual(F.col("kind")))


def album_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).when(F.col("doc_id") % 5 == 1, F.repeat("lang", F.lit(60))).otherwise(F.col("lang"))
    path = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source"))
    return rows.select("doc_id", ops.album_problem(name, path, F.col("text")).alias("problem"))


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null keeps name and place, an empty place clears it."""
    old = albums(spark, sf_dir).select("id", "name", "location")
    place = F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 2, "moved")
    new = old.where("id % 2 = 0").select("id", F.when(F.col("id") % 6 == 0, F.lit("renamed")).alias("name"), place.alias("location"))
    return ops.partly_updated(old, new, "id", clearable=("location",))


def batch_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of all albums named by suppliers set at once."""
    return ops.batch_updated(albums(spark, sf_dir).select("id", "location"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id", "location", F.lit("here"))


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums asked for by orders beyond the last customer fail."""
    return ops.batch_outcome(albums(spark, sf_dir), table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("id")), "id")


def batch_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.batch_failures(albums(spark, sf_dir), table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("id")).distinct(), "id")


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return albums(spark, sf_dir).where("id % 10 = 3 or id = 1").select(F.col("id").alias("source_id"), F.lit(1).cast("long").alias("target_id"))


def merged_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merged_albums(photos(spark, sf_dir).select("id", "album_id"), _merges(spark, sf_dir), True, "2024-01-01")[0]


def merge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merged_albums(photos(spark, sf_dir), _merges(spark, sf_dir), False, "2024-01-01")[1]


def merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order in the order of its items, as the merge sources of an album: few each."""
    noted = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    return ops.listed(noted, "l_orderkey", "l_linenumber", "part", "sources").select("l_orderkey", F.array_join("sources", "|").alias("sources"))


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    tops = region.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit(1).alias("level"), F.col("r_regionkey").cast("long").alias("sort_order"))
    middle = nation.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long"), F.lit(2), F.col("n_nationkey").cast("long"))
    leaves = supplier.select(F.col("s_suppkey") + 1000, (F.col("s_nationkey") + 100).cast("long"), F.lit(3), F.col("s_suppkey"))
    return tops.union(middle).union(leaves)


FOLDERS_SQL = """folders AS (SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, 1 AS level, r_regionkey::BIGINT AS sort_order FROM region
    UNION ALL SELECT n_nationkey + 100, n_regionkey, 2, n_nationkey FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, 3, s_suppkey FROM supplier)"""


def created_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder asked for by each customer: below a region, nation, supplier, an unknown one or none; some names are blank or begin with blanks."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 5
    parent = F.when(k == 0, F.col("c_nationkey") % 5).when(k == 1, F.col("c_nationkey") + 100).when(k == 2, F.lit(1001)).when(k == 3, F.lit(99_999_999))
    name = F.when(F.col("c_custkey") % 9 == 0, F.lit(" \t ")).when(F.col("c_custkey") % 9 == 1, F.concat(F.lit("  "), "c_name", F.lit("\n"))).otherwise(F.col("c_name"))
    return ops.created_folders(_folders(spark, sf_dir), c.select(name.alias("name"), parent.cast("long").alias("parent_id")))


def deleted_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders after region 2 went: its nations are roots."""
    left, _ = ops.without_folder(_folders(spark, sf_dir), albums(spark, sf_dir).select("id", F.lit(2).cast("long").alias("folder_id")), 2)
    return left


def detached_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = albums(spark, sf_dir).select("id", (F.col("id") % 5).cast("long").alias("folder_id"))
    return ops.without_folder(_folders(spark, sf_dir), own, 2)[1]


def folders_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folders at or below the regions with an A in their name and nation 3, at any depth."""
    region = table(spark, sf_dir, "region").where("r_name like '%A%'").select(F.col("r_regionkey").cast("long").alias("id"))
    return below(_folders(spark, sf_dir), region.union(spark.range(103, 104)))


def counts_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos below roots that are written in upper case, with other separators and one at the end."""
    roots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("\\LIB\\"), F.upper("n_name"), F.lit("\\")).alias("root"))
    return owners_any_case(photos(spark, sf_dir).select("id", "path"), roots).groupBy("root_id").agg(F.count("*").alias("n"))


def marks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden documents, latest first."""
    rows = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", (F.col("doc_id") % 90).alias("updated_at"))
    return ops.in_order(rows, [-F.col("updated_at")], "doc_id")


def first_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest mark whose document is there."""
    marks = table(spark, sf_dir, "labels").where("toxic = 1").withColumn("state", F.lit(ops.checked_state("hidden")))
    alive = marks.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    return alive.orderBy(F.desc(F.col("doc_id") % 90), "doc_id").limit(1).select("doc_id", "state")


def categories_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as categories: built-in ones first, then by their own order."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return ops.in_order(rows, [(F.col("p_brand") != "Brand#11").cast("int"), F.col("p_size")], "p_partkey")


def category_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where((F.col("p_partkey") == 7) & (F.col("p_size") > 0)).limit(1).select("p_partkey", "p_name")


def persons_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by number of faces."""
    rows = _faces(spark, sf_dir).groupBy("person_id").agg(F.count("*").alias("faces"))
    return ops.in_order(rows, [-F.col("faces")], "person_id")


def albums_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums by the time of their latest photo, none last, more photos first on ties."""
    latest = photos(spark, sf_dir).groupBy(F.col("album_id").alias("id")).agg(F.max("shoot_time").alias("t"), F.count("*").alias("n"))
    rows = albums(spark, sf_dir).select("id").join(latest, "id", "left").select("id", F.substring("t", 1, 7).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))
    stamp = F.coalesce(F.replace("t", F.lit("-"), F.lit("")).cast("int"), F.lit(0))
    return ops.in_order(rows, [-stamp, -F.col("n")], "id")


def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by level of their balance, then by the size of the gap, then by name."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") < 0, 0).when(F.col("c_acctbal") < 3000, 1).otherwise(2).alias("level"), F.floor(F.abs("c_acctbal") / 100).alias("gap"))
    return ops.in_order(rows, [F.col("level"), -F.col("gap"), F.col("c_name")], "c_custkey").select("c_custkey", "level", "gap", "place")


def places_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums by place, those without one last."""
    rows = albums(spark, sf_dir).select("id", F.when(F.col("id") % 9 > 0, F.col("location")).alias("location"))
    return ops.in_order(rows, [F.col("location").isNull(), F.col("location")], "id")


def category_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    words, out = F.array(F.concat(F.lit(" "), "lang"), F.lit(""), F.col("source"), F.col("lang")), F.array("source", F.lit(" no "))
    return rows.select("doc_id", F.array_join(ops.category_texts(words, out), ",").alias("texts"))


def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"en": "English", "de": "German", "fr": "French"}
    return table(spark, sf_dir, "documents").select("doc_id", ops.labelled(F.col("lang"), names).alias("label"))


def album_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached totals of orders stay where their number of items is the cached one."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("size"))
    cached = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 4 + 1).alias("file_count"), F.lit(0).cast("long").alias("bytes"))
    return ops.reused_stats(items, cached, "l_orderkey")


def index_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index lacks rows, so it is derived anew."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower("source").alias("content"))
    return ops.repaired_index(rows, rows.where("doc_id % 3 = 0"), "doc_id")


def sanitised_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of items by part and quantity; the wanted keeper is there or not, paths repeat in other case."""
    i = table(spark, sf_dir, "lineitem")
    path = F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("/A/")).otherwise(F.lit("/a/")), F.col("l_orderkey") % 3, F.lit("/x"), F.col("l_orderkey") % 50)
    items = i.select(F.concat_ws(":", "l_partkey", F.col("l_quantity").cast("int")).alias("group_id"), path.alias("path"), F.regexp_extract(path, "^(.*)/", 1).alias("dir"), F.lit(10).cast("long").alias("size"), F.lit("/a/1/x1").alias("keep_path"), (-8 * F.col("l_orderkey") - F.col("l_linenumber")).alias("place"))
    return ops.sanitised_groups(items)


def rekeyed_thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by the old formula, those of even ids, become fingerprints of path, size and time."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("old"), "page_id")).otherwise(F.concat(F.lit("own"), "page_id")).alias("key"))
    return ops.rekeyed(rows, "key", F.concat(F.lit("old"), "page_id"), fnv1a(F.concat_ws("|", "url", "page_id", F.lit("7")))).select("page_id", "key")


def relabelled_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of labels 1 and 2 count as those of label 0; a renamed one replaces one with the same key, and label 1, renamed last, one of label 2."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 100).alias("k"), F.col("label").cast("string").alias("model"), "vec_id")
    unique = rows.groupBy("k", "model").agg(F.min("vec_id").alias("vec_id"))
    return ops.relabelled(unique, ["k"], "model", ["2", "1"], "0")


def searched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.searched(table(spark, sf_dir, "documents"), "thnd ñdo", ["text"]).select("doc_id", "hits")


def searched_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword without words falls back to a substring."""
    return ops.searched(table(spark, sf_dir, "pages"), " ?? ", ["url", "html"]).select("page_id", "hits")


def dropped_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in a new schema: a column gone, one new with its default."""
    return table(spark, sf_dir, "customer").drop("c_acctbal").withColumn("role", F.lit("user"))


def vectors_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos outside exact groups with the vector of their path in any case; how many have none."""
    p = photos(spark, sf_dir).select("id", "path")
    grouped = p.where("id % 5 = 0").select("path")
    known = p.where("id % 3 > 0").select(F.upper("path").alias("vector_path"), F.col("id").alias("vec_id"))
    left = p.join(grouped, "path", "left_anti").join(known, F.lower("path") == F.lower("vector_path"), "left")
    return left.agg(F.count("vec_id").alias("found"), F.count_if(F.col("vec_id").isNull()).alias("missing"))


def persons_in_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and roots come in other cases and with other separators, and every seventh person is unknown."""
    faces = _faces(spark, sf_dir)
    roots = faces.select(F.regexp_extract("path", "^(/lib/[^/]+)", 1).alias("root")).distinct().select(F.char_length("root").cast("long").alias("id"), F.concat(F.upper("root"), F.lit("/")).alias("root"))
    path = F.when(F.col("face_id") % 3 == 0, F.upper("path")).when(F.col("face_id") % 3 == 1, F.translate("path", "/", "\\")).otherwise(F.col("path"))
    persons = faces.select("person_id").distinct().where("cast(substring(person_id, 2) as bigint) % 7 <> 0").withColumn("name", F.concat(F.lit("name "), "person_id"))
    return people.persons_below(faces.withColumn("path", path), persons, roots.groupBy("root").agg(F.min("id").alias("id")))


def person_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("person_id"))
    return people.with_signature(persons, _faces(spark, sf_dir))


def face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one person on one photo each, the least of several."""
    return _faces(spark, sf_dir).groupBy("person_id", "path").agg(F.min("box").alias("box"))


def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in (("P1", "Ann"), ("P2", ""), ("P3", "Bo"), ("P4", "Ann")) for x in pair))
    ids = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)), lambda i: F.concat(F.lit("P"), (F.col("doc_id") + i) % 6))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(people.names_of(ids, names), ",").alias("names"))


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faces(spark, sf_dir).where("value >= 50").groupBy("path", "box").agg(F.concat(F.lit("Q"), F.min("face_id")).alias("person_id"))


def overridden_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = people.with_overrides(_faces(spark, sf_dir), _overrides(spark, sf_dir))
    return faces.groupBy(F.col("person_id").startswith("Q").alias("given")).agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("persons"))


def set_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _overrides(spark, sf_dir).where("box = '3'").withColumn("person_id", F.lit("R"))
    return people.set_overrides(_overrides(spark, sf_dir), new)


def moved_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    return people.moved_faces(faces, _overrides(spark, sf_dir), "P7", "P8", faces.where("box = '2'"))[0].groupBy("person_id").agg(F.count("*").alias("n"))


def move_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    return people.moved_faces(faces, _overrides(spark, sf_dir), "P7", "P8", faces.where("box = '2'"))[1]


def dropped_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    return people.moved_faces(faces, _overrides(spark, sf_dir), "P7", None, faces.where("box = '2'"))[0].groupBy("person_id").agg(F.count("*").alias("n"))


def recomputed_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("person_id"), "embedding")
    return people.person_centroids(faces).select("person_id", "faces", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.get("centroid", F.lit(5)), 6).alias("sixth"))


def face_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that show persons join the queue, which has every fourth already."""
    ids = F.when(F.col("id") % 3 == 0, "[]").when(F.col("id") % 3 == 1, '["P1"]')
    rows = photos(spark, sf_dir).select("path", "id", ids.alias("person_ids"), (F.col("id") % 2).alias("person_count"))
    return people.rebuild_queue(rows.where("id % 4 = 0").select("path", F.lit(1).cast("long").alias("added_at")), rows, 9).groupBy("added_at").agg(F.count("*").alias("n"))


def registry_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, faces, persons = people.reset_counts(_faces(spark, sf_dir), table(spark, sf_dir, "customer"))
    return counts.withColumn("left_over", F.lit(faces.count() + persons.count()).cast("long"))


def face_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as faces: points and boxes made up from quantities, discounts and taxes."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    box = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (q * 3 + 20).alias("x2"), F.lit(90.0).alias("y2"))
    points = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((q, F.lit(30.0)), (q + 30, 30 + t * 200), (q + 15 + d * 200, F.lit(45.0)), (q + 5, F.lit(60.0)), (q + 25, F.lit(60.0)))))
    return table(spark, sf_dir, "lineitem").groupBy(people.face_verdict(box, points).alias("verdict")).agg(F.count("*").alias("n"))


def cover_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    box = F.struct((n * 40).alias("x1"), q.alias("y1"), (n * 40 + q).alias("x2"), (q * 3).alias("y2"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", people.cover_rectangle(F.lit(400.0), F.lit(300.0), box, 0.8, 0.6).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    boxes = i.select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") % 4).alias("kind"), F.col("l_discount").alias("conf"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), F.lit(2.0).alias("y2"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))
    return people.detections(boxes, [0], [2, 3]).withColumn("max_area", F.round("max_area", 9))


def reading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each part as text boxes in reading order: the box that comes first, its row and place."""
    i = table(spark, sf_dir, "lineitem")
    box = F.struct(F.col("l_quantity").cast("double").alias("x1"), (F.col("l_linenumber") * 9).cast("double").alias("y1"), (F.col("l_linenumber") * 9 + F.col("l_quantity")).cast("double").alias("y2"))
    keyed = i.select("l_partkey", people.reading_order(box).alias("k"), "l_orderkey", "l_linenumber")
    first = keyed.groupBy("l_partkey").agg(F.min(F.struct("k", "l_orderkey", "l_linenumber")).alias("b"))
    return first.select("l_partkey", F.col("b.k.row").cast("int").alias("row"), F.col("b.l_orderkey").alias("l_orderkey"), F.col("b.l_linenumber").alias("l_linenumber"))


def structured_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a month query finds by its date, with both ways to write it."""
    t = F.when(F.col("id") % 2 == 0, F.replace("shoot_time", F.lit("-"), F.lit("/"))).otherwise(F.col("shoot_time"))
    return photos(spark, sf_dir).where(t.startswith("1996-03") | t.startswith("1996/03")).select("id", F.lit(1).alias("relevance"))


def badge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 2 == 0, "object").otherwise("place")
    image, text = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scans.badge_lane(kind, image, text).alias("score"))


def scan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    both = scans.merged_report(k % 11, k % 7, k % 3, k % 5)
    return o.select("o_orderkey", scans.skipped(k % 13, k % 17).alias("skipped"), both["written"].alias("written"), both["failed"].alias("failed"))


def phase_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as phases of an order, whose price is the wall time."""
    spans = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.col("l_quantity").cast("double").alias("ms"), (F.col("o_orderkey") % 150).cast("double").alias("wall"))
    rows = scans.phase_balance(spans, "o_orderkey", "ms", "wall")
    return rows.select("o_orderkey", F.round("total", 4).alias("total"), F.round("rest", 4).alias("rest"), scans.duration(F.col("overlap")).alias("overlap"))


def phase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as phases of an order, told in one line; orders without items have none."""
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    spans = i.select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), "l_linenumber").alias("name"), (F.col("q").cast("double") / 4).alias("ms"), F.when(F.col("l_linenumber") % 3 == 0, F.lit("n")).otherwise("").alias("note"))
    walls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 150 / 4.0).cast("double").alias("wall"))
    return scans.phase_lines(spans, "l_orderkey", "l_linenumber", "name", "ms", "note", walls, "wall")


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera dates, seconds and civil times of orders."""
    p = photos(spark, sf_dir)
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit('"'), F.replace("shoot_time", F.lit("-"), F.lit(":")), F.lit('"'))).when(F.col("id") % 3 == 1, F.lit("2020:xx:01"))
    part = [F.substring("shoot_time", a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))]
    seconds = scans.unix_seconds(*part)
    back = scans.civil_time(seconds - 900_000_000)
    return p.select("id", scans.iso_date(raw).alias("iso"), seconds.alias("seconds"), back["year"].alias("year"), back["day"].alias("day"), back["hour"].alias("hour"))


def content_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    sub = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return d.select("doc_id", scans.content_text(F.upper("lang"), sub, F.lit(""), F.array("source", F.lit("")), F.array(F.concat(F.lit("P"), "doc_id"))).alias("content"))


def resolved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", scans.resolved_place(F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), "c_name")), F.col("c_mktsegment")).alias("place"))


def plain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = photos(spark, sf_dir)
    rows = scans.plain_records(p.where("id % 3 > 0"), p.where("id % 2 = 0"))
    return rows.groupBy("tone", "owns_exif", "owns_ai").agg(F.count("*").alias("n"), F.count("shoot_time").alias("timed"), F.count("category").alias("recognised"))


def tone_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as pixels of an order."""
    i = table(spark, sf_dir, "lineitem")
    value = scans.luma((F.col("l_quantity") * 5).cast("long"), F.col("l_linenumber").cast("long") * 30, F.col("l_partkey") % 256)
    return i.groupBy("l_orderkey").agg(F.round(F.avg(value), 6).alias("luma"))


def clamped_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((scans.similarity_threshold(F.col("l_quantity") / 45.0) >= 1).alias("top")).agg(F.count("*").alias("n"))


def vector_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes and back."""
    v = table(spark, sf_dir, "embeddings").withColumn("b", scans.bytes_of_vector("embedding"))
    return v.select("vec_id", F.octet_length("b").alias("bytes"), F.get(scans.vector_of_bytes("b"), F.lit(2)).alias("third"))


QUERIES = {
    f.__name__: f
    for f in (
        virtual_albums, album_problems, partial_update, batch_places, batch_report, batch_misses, merged_photos, merge_provenance, merge_lists, created_folders, deleted_folder, detached_albums, folders_below, counts_any_case,
        marks_in_order, first_mark, categories_in_order, category_by_id, persons_in_order, albums_in_order, severity_order, places_in_order, category_words, category_labels, album_stats,
        index_repair, sanitised_report, rekeyed_thumbs, relabelled_models, searched_documents, searched_symbols, dropped_column, vectors_by_path, persons_in_albums, person_signatures, face_boxes,
        person_names, overridden_faces, set_overrides, moved_faces, move_overrides, dropped_faces, recomputed_centroids, face_queue, registry_reset, face_gate, cover_rectangles,
        detection_summary, reading_rows, structured_truth, badge_scores, scan_reports, phase_balances, phase_lines, written_dates, content_texts, resolved_places, plain_records, tone_means,
        clamped_thresholds, vector_bytes,
    )
}

_OVER = "o AS (SELECT path, box, 'Q' || min(face_id) AS person_id FROM faces WHERE value >= 50 GROUP BY 1, 2)"
_DURATION = "CASE WHEN {v} >= 100 THEN format('{{:.0f}}', {v}) WHEN {v} >= 10 THEN format('{{:.1f}}', {v}) ELSE format('{{:.2f}}', {v}) END"
_WORDS = r"regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')"

ORACLES = {
    "virtual_albums": """SELECT s_suppkey AS user_id, k AS kind, CASE WHEN k = 'hidden' AND s_suppkey % 3 = 0 THEN 'mine' ELSE k END AS name, true AS virtual FROM supplier, (VALUES ('archived'), ('hidden')) v(k)""",
    "album_problems": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'name' WHEN doc_id % 5 = 1 AND length(lang) * 60 > 100 THEN 'name length' WHEN doc_id % 7 = 0 THEN 'path' WHEN length(text) > 500 THEN 'description length' END AS problem FROM documents""",
    "partial_update": f"""WITH {ALBUMS_SQL} SELECT id, CASE WHEN id % 6 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 2 THEN 'moved' ELSE location END AS location FROM albums""",
    "batch_places": f"WITH {ALBUMS_SQL} SELECT id, CASE WHEN id IN (SELECT s_suppkey FROM supplier) THEN 'here' ELSE location END AS location FROM albums",
    "batch_report": f"WITH {ALBUMS_SQL} SELECT count(*) AS requested, count(id) AS ok, count(*) FILTER (id IS NULL) AS failed FROM orders LEFT JOIN albums ON o_custkey * 2 = id",
    "batch_misses": f"WITH {ALBUMS_SQL} SELECT DISTINCT o_custkey * 2 AS id FROM orders WHERE o_custkey * 2 NOT IN (SELECT id FROM albums)",
    "merged_photos": f"WITH {PHOTOS_SQL}, {ALBUMS_SQL} SELECT id, CASE WHEN album_id IN (SELECT id FROM albums WHERE id % 10 = 3) THEN 1 ELSE album_id END AS album_id FROM photos",
    "merge_provenance": f"WITH {PHOTOS_SQL}, {ALBUMS_SQL} SELECT 1::BIGINT AS target_id, a.id AS source_id, count(p.id) AS n_photos, '2024-01-01' AS merged_at FROM albums a LEFT JOIN photos p ON p.album_id = a.id WHERE a.id % 10 = 3 GROUP BY a.id",
    "merge_lists": "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, '|' ORDER BY l_linenumber, l_partkey::VARCHAR) AS sources FROM lineitem GROUP BY 1",
    "created_folders": f"""WITH {FOLDERS_SQL}, q AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS name, CASE c_custkey % 5 WHEN 0 THEN c_nationkey % 5 WHEN 1 THEN c_nationkey + 100 WHEN 2 THEN 1001 WHEN 3 THEN 99999999 END AS parent_id FROM customer),
        r AS (SELECT q.*, f.level AS above, CASE WHEN name = '' THEN 'name' WHEN q.parent_id IS NOT NULL AND f.id IS NULL THEN 'parent' WHEN f.level >= 3 THEN 'level' END AS problem,
          (SELECT max(sort_order) FROM folders s WHERE s.parent_id IS NOT DISTINCT FROM q.parent_id) AS last, row_number() OVER (PARTITION BY q.parent_id, name = '' ORDER BY name) - 1 AS nth FROM q LEFT JOIN folders f ON f.id = q.parent_id)
        SELECT name, parent_id::BIGINT AS parent_id, CASE WHEN problem IS NULL THEN coalesce(above, 0) + 1 END AS level, CASE WHEN problem IS NULL THEN coalesce(last, -1) + 1 + nth END AS sort_order, problem FROM r""",
    "deleted_folder": f"WITH {FOLDERS_SQL} SELECT id, CASE WHEN parent_id <> 2 THEN parent_id END AS parent_id, CASE WHEN parent_id = 2 THEN 1 ELSE level END AS level, sort_order FROM folders WHERE id <> 2",
    "detached_albums": f"WITH {ALBUMS_SQL} SELECT id, CASE WHEN id % 5 <> 2 THEN id % 5 END AS folder_id FROM albums",
    "folders_below": f"""WITH RECURSIVE {FOLDERS_SQL}, t AS (SELECT id, 0 AS steps FROM folders WHERE id = 103 OR id IN (SELECT r_regionkey FROM region WHERE r_name LIKE '%A%') UNION SELECT f.id, t.steps + 1 FROM folders f JOIN t ON f.parent_id = t.id)
        SELECT id, min(steps)::INT AS steps FROM t GROUP BY 1""",
    "counts_any_case": "SELECT c_nationkey::BIGINT AS root_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "marks_in_order": "SELECT doc_id, doc_id % 90 AS updated_at, row_number() OVER (ORDER BY doc_id % 90 DESC, doc_id) - 1 AS place FROM labels WHERE toxic = 1",
    "first_mark": "SELECT doc_id, 'hidden' AS state FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents) ORDER BY doc_id % 90 DESC, doc_id LIMIT 1",
    "categories_in_order": "SELECT p_partkey, p_brand, p_size, row_number() OVER (ORDER BY p_brand <> 'Brand#11', p_size, p_partkey) - 1 AS place FROM part",
    "category_by_id": "SELECT p_partkey, p_name FROM part WHERE p_partkey = 7 AND p_size > 0",
    "persons_in_order": f"WITH {FACES_SQL} SELECT person_id, count(*) AS faces, row_number() OVER (ORDER BY count(*) DESC, person_id) - 1 AS place FROM faces GROUP BY 1",
    "albums_in_order": f"""WITH {PHOTOS_SQL}, {ALBUMS_SQL}, l AS (SELECT album_id, max(shoot_time)[1:7] AS t, count(*) AS n FROM photos GROUP BY 1), r AS (SELECT albums.id, t, coalesce(n, 0) AS n FROM albums LEFT JOIN l ON album_id = albums.id)
        SELECT id, t, n, row_number() OVER (ORDER BY t DESC NULLS LAST, n DESC, id) - 1 AS place FROM r""",
    "severity_order": """WITH r AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 3000 THEN 1 ELSE 2 END AS level, floor(abs(c_acctbal) / 100)::BIGINT AS gap FROM customer)
        SELECT c_custkey, level, gap, row_number() OVER (ORDER BY level, gap DESC, c_name, c_custkey) - 1 AS place FROM r""",
    "places_in_order": f"WITH {ALBUMS_SQL}, r AS (SELECT id, CASE WHEN id % 9 > 0 THEN location END AS location FROM albums) SELECT id, location, row_number() OVER (ORDER BY location ASC NULLS LAST, id) - 1 AS place FROM r",
    "category_words": "SELECT doc_id, lang || ',' || source || ',no' AS texts FROM documents",
    "category_labels": "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE lang END AS label FROM documents",
    "album_stats": "SELECT l_orderkey, count(*) AS file_count, CASE WHEN count(*) = l_orderkey % 4 + 1 THEN 0 ELSE sum(l_linenumber) END::BIGINT AS bytes, count(*) = l_orderkey % 4 + 1 AS reused FROM lineitem GROUP BY 1",
    "index_repair": "SELECT doc_id, lower(source) AS content FROM documents",
    "sanitised_report": """WITH i AS (SELECT l_partkey || ':' || l_quantity::INT AS group_id, CASE WHEN l_linenumber % 2 = 0 THEN '/A/' ELSE '/a/' END || l_orderkey % 3 AS dir, '/x' || l_orderkey % 50 AS name, -8 * l_orderkey - l_linenumber AS place FROM lineitem),
        s AS (SELECT group_id, arg_min(dir || name, (place, dir || name)) AS path, arg_min(dir, (place, dir || name)) AS dir, min(place) AS place FROM i GROUP BY group_id, lower(dir || name)), c AS (SELECT group_id, count(*) AS raw FROM i GROUP BY 1),
        k AS (SELECT group_id, count(*) AS items, coalesce(min(path) FILTER (path = '/a/1/x1'), arg_min(path, (place, path))) AS keep FROM s GROUP BY 1)
        SELECT s.group_id, keep AS keep_path, items, count(*) AS deletable, (count(*) * 10)::BIGINT AS reclaimable, max(raw) - items AS collapsed FROM s JOIN k USING (group_id) JOIN c USING (group_id)
        WHERE path <> keep AND lower(dir) <> lower(regexp_extract(keep, '^(.*)/', 1)) GROUP BY 1, 2, 3""",
    "rekeyed_thumbs": f"""WITH p AS (SELECT page_id, url || '|' || page_id || '|7' AS t FROM pages) SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {FNV_SQL.format(t="t")} ELSE 'own' || page_id END AS key FROM p""",
    "relabelled_models": """WITH u AS (SELECT vec_id % 100 AS k, label::VARCHAR AS model, min(vec_id) AS vec_id FROM embeddings GROUP BY 1, 2), n AS (SELECT k, CASE WHEN model IN ('1', '2') THEN '0' ELSE model END AS m, CASE model WHEN '1' THEN 2 WHEN '2' THEN 1 ELSE 0 END AS turn, vec_id FROM u)
        SELECT k, m AS model, arg_max(vec_id, turn) AS vec_id FROM n GROUP BY 1, 2""",
    "searched_documents": f"""WITH h AS (SELECT doc_id, list_contains({_WORDS}, 'thnd')::INT + (len(list_filter({_WORDS}, lambda w: starts_with(w, 'ñdo'))) > 0)::INT AS hits FROM documents) SELECT * FROM h WHERE hits > 0""",
    "searched_symbols": "SELECT page_id, 0 AS hits FROM pages WHERE contains(lower(concat_ws(' ', url, html)), '??')",
    "dropped_column": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 'user' AS role FROM customer",
    "vectors_by_path": f"WITH {PHOTOS_SQL} SELECT count(*) FILTER (id % 3 > 0) AS found, count(*) FILTER (id % 3 = 0) AS missing FROM photos WHERE id % 5 <> 0",
    "persons_in_albums": f"""WITH {FACES_SQL}, f AS (SELECT *, regexp_extract(path, '^(/lib/[^/]+)', 1) AS root, CASE face_id % 3 WHEN 0 THEN upper(path) WHEN 1 THEN replace(path, '/', chr(92)) ELSE path END AS p FROM faces WHERE person_id[2:]::BIGINT % 7 <> 0)
        SELECT length(root)::BIGINT AS root_id, person_id, 'name ' || person_id AS name, count(DISTINCT p) AS photos FROM f GROUP BY 1, 2""",
    "person_signatures": f"WITH {FACES_SQL}, s AS (SELECT person_id, count(*) || ':' || max(face_id) AS signature FROM faces GROUP BY 1) SELECT 'P' || c_custkey AS person_id, signature FROM customer LEFT JOIN s ON s.person_id = 'P' || c_custkey",
    "face_boxes": f"WITH {FACES_SQL} SELECT person_id, path, min(box) AS box FROM faces GROUP BY 1, 2",
    "person_names": """SELECT doc_id, array_to_string(CASE doc_id % 6 WHEN 0 THEN ['Ann', 'Bo'] WHEN 1 THEN ['Ann', 'Bo'] WHEN 2 THEN ['Bo', 'Ann'] WHEN 3 THEN ['Bo', 'Ann'] WHEN 4 THEN ['Ann'] ELSE ['Ann'] END, ',') AS names FROM documents""",
    "overridden_faces": f"WITH {FACES_SQL}, {_OVER} SELECT o.person_id IS NOT NULL AS given, count(*) AS n, count(DISTINCT coalesce(o.person_id, f.person_id)) AS persons FROM faces f LEFT JOIN o USING (path, box) GROUP BY 1",
    "set_overrides": f"WITH {FACES_SQL}, {_OVER} SELECT path, box, CASE WHEN box = '3' THEN 'R' ELSE person_id END AS person_id FROM o",
    "moved_faces": f"WITH {FACES_SQL}, m AS (SELECT CASE WHEN person_id = 'P7' AND path IN (SELECT path FROM faces WHERE box = '2') THEN 'P8' ELSE person_id END AS person_id FROM faces) SELECT person_id, count(*) AS n FROM m GROUP BY 1",
    "move_overrides": f"""WITH {FACES_SQL}, {_OVER}, n AS (SELECT DISTINCT path, box FROM faces WHERE person_id = 'P7' AND path IN (SELECT path FROM faces WHERE box = '2'))
        SELECT coalesce(n.path, o.path) AS path, coalesce(n.box, o.box) AS box, CASE WHEN n.path IS NULL THEN person_id ELSE 'P8' END AS person_id FROM o FULL JOIN n ON n.path = o.path AND n.box = o.box""",
    "dropped_faces": f"WITH {FACES_SQL} SELECT person_id, count(*) AS n FROM faces WHERE NOT (person_id = 'P7' AND path IN (SELECT path FROM faces WHERE box = '2')) GROUP BY 1",
    "recomputed_centroids": """WITH f AS (SELECT vec_id % 40 AS person_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT person_id, i, avg(x) AS m, count(*) AS n FROM f GROUP BY 1, 2),
        l AS (SELECT person_id, max(n) AS faces, sqrt(sum(m * m)) AS l, max(m) FILTER (i = 1) AS a, max(m) FILTER (i = 6) AS b FROM m GROUP BY 1) SELECT person_id, faces, round(a / l, 6) AS first, round(b / l, 6) AS sixth FROM l""",
    "face_queue": f"WITH {PHOTOS_SQL}, q AS (SELECT CASE WHEN id % 4 = 0 THEN 1 ELSE 9 END AS added_at FROM photos WHERE id % 4 = 0 OR id % 3 = 1 OR id % 2 > 0) SELECT added_at::BIGINT AS added_at, count(*) AS n FROM q GROUP BY 1",
    "registry_reset": "SELECT (SELECT count(*) FROM events) AS faces, (SELECT count(*) FROM customer) AS persons, 0::BIGINT AS left_over",
    "face_gate": """WITH g AS (SELECT l_quantity * 3 + 20 AS w, l_quantity AS q, l_discount AS d, l_tax AS t, sqrt(900 + (l_tax * 200) ** 2) AS e FROM lineitem),
        r AS (SELECT w, abs(q + 15 + d * 200 - (q + q + 30) / 2) / e AS yaw, abs(degrees(atan2(30 + t * 200 - 30.0, 30.0))) AS roll, least(w, 90) AS side, w / 90 AS aspect, e / w AS span, (45 - (30 + 30 + t * 200) / 2) / e AS nose, 15 / e AS mouth FROM g)
        SELECT CASE WHEN side < 48 OR yaw > 0.5 OR roll > 32 OR aspect NOT BETWEEN 0.62 AND 1.6 OR span NOT BETWEEN 0.28 AND 0.58 OR nose NOT BETWEEN 0.12 AND 1 OR mouth NOT BETWEEN 0.1 AND 1.6 THEN 'reject'
          WHEN yaw > 0.35 OR roll > 25 OR side < 64 THEN 'marginal' ELSE 'ok' END AS verdict, count(*) AS n FROM r GROUP BY 1""",
    "cover_rectangles": """WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber * 40 + l_quantity / 2 AS mx, l_quantity * 2 AS my, greatest(l_quantity, l_quantity * 2, 1.0) * 2.2 AS cw FROM lineitem),
        s AS (SELECT *, least(1.0, 400 / cw, 300 / (cw / 0.8)) AS k FROM b), t AS (SELECT *, cw * k AS ww, cw / 0.8 * k AS hh FROM s)
        SELECT l_orderkey, l_linenumber, round(least(greatest(mx - ww / 2, 0), greatest(400 - ww, 0)))::INT AS x, round(least(greatest(my - hh * 0.06 - hh / 2, 0), greatest(300 - hh, 0)))::INT AS y,
          greatest(round(ww), 1)::INT AS w, greatest(round(hh), 1)::INT AS h FROM t""",
    "detection_summary": """SELECT l_orderkey AS image, count(*) FILTER (l_linenumber % 4 = 0) AS persons, count(*) FILTER (l_linenumber % 4 >= 2) AS vehicles, coalesce(max(l_discount) FILTER (l_linenumber % 4 = 0), 0)::DOUBLE AS max_conf,
        round(coalesce(max(l_quantity * 2 / 5000) FILTER (l_linenumber % 4 = 0), 0), 9)::DOUBLE AS max_area FROM lineitem GROUP BY 1""",
    "reading_rows": """WITH k AS (SELECT l_partkey, round_even(l_linenumber * 9 / greatest(12.0, l_quantity * 0.8), 0)::INT AS row, l_quantity AS x, l_orderkey, l_linenumber FROM lineitem)
        SELECT l_partkey, row, l_orderkey, l_linenumber FROM k QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY row, x, l_orderkey, l_linenumber) = 1""",
    "structured_truth": f"WITH {PHOTOS_SQL} SELECT id, 1 AS relevance FROM photos WHERE starts_with(shoot_time, '1996-03')",
    "badge_scores": """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS i, CASE WHEN l_linenumber % 5 > 0 THEN l_tax END AS t FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN coalesce(i, t) ELSE coalesce(t, i) END AS score FROM s""",
    "scan_reports": "SELECT o_orderkey, greatest(0, o_orderkey % 13 - o_orderkey % 17) AS skipped, greatest(o_orderkey % 11, o_orderkey % 7) AS written, o_orderkey % 3 + o_orderkey % 5 AS failed FROM orders",
    "phase_balances": f"""WITH r AS (SELECT o_orderkey, sum(l_quantity)::DOUBLE AS total, max(o_orderkey % 150)::DOUBLE AS wall FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), s AS (SELECT o_orderkey, total, greatest(0.0, wall - total) AS rest, greatest(0.0, total - wall)::DOUBLE AS v FROM r)
        SELECT o_orderkey, round(total, 4) AS total, round(rest, 4)::DOUBLE AS rest, {_DURATION.format(v="v")} AS overlap FROM s""",
    "phase_lines": f"""WITH i AS (SELECT l_orderkey, l_linenumber AS n, sum(l_quantity)::DOUBLE / 4 AS ms FROM lineitem GROUP BY 1, 2),
        p AS (SELECT l_orderkey, sum(ms) AS total, string_agg('p' || n || ' ' || {_DURATION.format(v="ms")} || CASE WHEN n % 3 = 0 THEN '(n)' ELSE '' END, ' · ' ORDER BY n) AS parts FROM i GROUP BY 1),
        w AS (SELECT o_orderkey, o_orderkey % 150 / 4.0::DOUBLE AS wall, total, parts, total - o_orderkey % 150 / 4.0::DOUBLE AS over, greatest(0.0::DOUBLE, o_orderkey % 150 / 4.0::DOUBLE - total) AS rest FROM orders LEFT JOIN p ON l_orderkey = o_orderkey)
        SELECT o_orderkey AS l_orderkey, '总 ' || {_DURATION.format(v="wall")} || 'ms | ' || CASE WHEN parts IS NULL THEN '无阶段记录' ELSE parts || ' | ' ||
          CASE WHEN over > 0.5 THEN '阶段重叠(并发) ~' || {_DURATION.format(v="over")} ELSE '未计入(调度/序列化/等待) ' || {_DURATION.format(v="rest")} END END AS line FROM w""",
    "written_dates": f"""WITH {PHOTOS_SQL}, s AS (SELECT id, shoot_time, epoch(strptime(shoot_time, '%Y-%m-%d %H:%M:%S'))::BIGINT AS seconds FROM photos), t AS (SELECT *, make_timestamp((seconds - 900000000) * 1000000) AS b FROM s)
        SELECT id, CASE WHEN id % 3 = 0 THEN shoot_time[1:10] END AS iso, seconds, year(b)::INT AS year, day(b)::INT AS day, hour(b)::INT AS hour FROM t""",
    "content_texts": "SELECT doc_id, lower(concat_ws(' ', upper(lang), CASE WHEN doc_id % 2 = 0 THEN source END, source, 'P' || doc_id)) AS content FROM documents",
    "resolved_places": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE c_mktsegment END AS place FROM customer",
    "plain_records": f"""WITH {PHOTOS_SQL} SELECT CASE WHEN id % 2 = 0 THEN tone END AS tone, id % 3 > 0 AS owns_exif, false AS owns_ai, count(*) AS n, count(shoot_time) FILTER (id % 3 > 0) AS timed, 0::BIGINT AS recognised
        FROM photos WHERE id % 3 > 0 OR id % 2 = 0 GROUP BY 1, 2""",
    "tone_means": "SELECT l_orderkey, round(avg(((l_quantity * 5)::BIGINT * 299 + l_linenumber * 30 * 587 + l_partkey % 256 * 114) // 1000), 6) AS luma FROM lineitem GROUP BY 1",
    "clamped_thresholds": "SELECT l_quantity / 45.0 >= 1 AS top, count(*) AS n FROM lineitem GROUP BY 1",
    "vector_bytes": "SELECT vec_id, len(embedding) * 4 AS bytes, embedding[3] AS third FROM embeddings",
}
