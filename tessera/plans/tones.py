"""Colour transfer, map positions and loosely written JSON; items of the generated tables stand for pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import photo, text
from tessera.operators import transfer
from tessera.sources.tables import table


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        number.alias("id"),
        "l_returnflag",
        (F.col("l_partkey") % 256).cast("int").alias("r"),
        (F.col("l_suppkey") * 7 % 256).cast("int").alias("g"),
        (F.col("l_orderkey") % 256).cast("int").alias("b"),
    )


def lab_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items take the Lab moments of the others, lightness by half."""
    pixels = _pixels(spark, sf_dir).withColumn("c", transfer.lab(F.col("r"), F.col("g"), F.col("b"))).select("id", "l_returnflag", F.col("c.l").alias("l"), F.col("c.a").alias("a"), F.col("c.b").alias("b"))
    returned = F.col("l_returnflag") == "R"
    moved = transfer.matched_moments(pixels.where(returned), pixels.where(~returned), ["l", "a", "b"], [0.5, 1.0, 1.0])
    light = F.least(F.lit(100.0), F.greatest(F.lit(0.0), "l"))
    return moved.select("id", F.round(light, 4).alias("l"), F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def rank_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red levels of returned items matched to the green levels of accepted ones."""
    pixels = _pixels(spark, sf_dir)
    source = pixels.where("l_returnflag = 'R'").select("id", F.col("r").alias("v"))
    reference = pixels.where("l_returnflag = 'A'").select(F.col("g").alias("v"))
    return transfer.matched_ranks(source, reference, "id", "v")


def map_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer on the map, customers spread over a wider region than it shows."""
    places = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select(
        "o_custkey", "n", (F.col("o_custkey") % 700 / 10.0 + 70).alias("lon"), (F.col("o_custkey") % 410 / 10.0 + 15).alias("lat")
    )
    at = photo.map_point(F.col("lon"), F.col("lat"), 800.0, 12.0)
    return places.where(photo.on_map(F.col("lon"), F.col("lat"))).select(
        "o_custkey", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"), F.round(photo.point_radius(F.col("n")), 6).alias("radius")
    )


def loose_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, wrapped as a talkative writer would."""
    key = F.col("event_id") % 5
    fence = "```"
    wrapped = (
        F.when(key == 0, F.col("props"))
        .when(key == 1, F.concat(F.lit(f"{fence}json\n"), F.col("props"), F.lit(f"\n{fence}")))
        .when(key == 2, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" as you asked.")))
        .when(key == 3, F.lit("no object } here {"))
    )
    found = text.loose_object(wrapped)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object(found, "$.k"), F.lit("-")).alias("k"), (found == "{}").alias("none"))


def shadow_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some table names belong to a text index."""
    suffix = F.explode(F.array(*map(F.lit, ["", "_fts", "_fts_data", "_fts_segments", "_data", "_fts_rows"])))
    names = table(spark, sf_dir, "nation").select("n_name", suffix.alias("suffix")).select(F.concat(F.lower("n_name"), "suffix").alias("name"))
    return names.withColumn("shadow", text.is_shadow_table(F.col("name")))


QUERIES = {f.__name__: f for f in (lab_transfer, rank_transfer, map_positions, loose_objects, shadow_tables)}

_PIXELS = "p AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag, (l_partkey % 256)::INT AS r, (l_suppkey * 7 % 256)::INT AS g, (l_orderkey % 256)::INT AS b FROM lineitem)"
_LINEAR = "CASE WHEN {c} / 255.0 <= 0.04045 THEN {c}::DOUBLE / 255 / 12.92 ELSE pow(({c}::DOUBLE / 255 + 0.055) / 1.055, 2.4) END AS {c}"
_CURVE = "CASE WHEN {t} > 0.008856451679035631 THEN cbrt({t}) ELSE {t} / 0.12841854934601665 + 4.0 / 29 END AS f{t}"
_MOVED = "{c} * (1 - {w}) + ((({c} - s.m{c}) * ((q.d{c} + 1e-6) / (s.d{c} + 1e-6))) + q.m{c}) * {w}"
_MOMENTS = ", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS d{c}" for c in "lab")
ORACLES = {
    "lab_transfer": f"""WITH {_PIXELS}, n AS (SELECT id, l_returnflag, {", ".join(_LINEAR.format(c=c) for c in "rgb")} FROM p),
        z AS (SELECT id, l_returnflag, (0.4124564::DOUBLE * r + 0.3575761::DOUBLE * g + 0.1804375::DOUBLE * b) / 0.95047::DOUBLE AS x, 0.2126729::DOUBLE * r + 0.7151522::DOUBLE * g + 0.0721750::DOUBLE * b AS y,
          (0.0193339::DOUBLE * r + 0.1191920::DOUBLE * g + 0.9503041::DOUBLE * b) / 1.08883::DOUBLE AS z FROM n),
        f AS (SELECT id, l_returnflag, {", ".join(_CURVE.format(t=t) for t in "xyz")} FROM z),
        c AS (SELECT id, l_returnflag, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM f),
        s AS (SELECT {_MOMENTS} FROM c WHERE l_returnflag = 'R'), q AS (SELECT {_MOMENTS} FROM c WHERE l_returnflag <> 'R')
        SELECT id, round(least(100, greatest(0, {_MOVED.format(c="l", w="0.5::DOUBLE")})), 4) AS l, round({_MOVED.format(c="a", w=1)}, 4) AS a, round({_MOVED.format(c="b", w=1)}, 4) AS b
        FROM c, s, q WHERE l_returnflag = 'R'""",
    "rank_transfer": f"""WITH {_PIXELS}, s AS (SELECT id, r AS v, row_number() OVER (ORDER BY r, id) - 1 AS rank, count(*) OVER () AS n FROM p WHERE l_returnflag = 'R'),
        q AS (SELECT list(g ORDER BY g) AS levels, count(*) AS m FROM p WHERE l_returnflag = 'A')
        SELECT id, v, levels[least(m - 1, floor(rank / greatest(n - 1, 1)::DOUBLE * (m - 1)))::BIGINT + 1] AS matched FROM s, q""",
    "map_positions": """WITH o AS (SELECT o_custkey, count(*) AS n, o_custkey % 700 / 10::DOUBLE + 70 AS lon, o_custkey % 410 / 10::DOUBLE + 15 AS lat FROM orders GROUP BY o_custkey)
        SELECT o_custkey, round(12 + (lon - 73.5) * ((800 - 24) / (135.1::DOUBLE - 73.5::DOUBLE)), 6) AS x, round(12 + (53.6::DOUBLE - lat) * ((800 - 24) / (135.1::DOUBLE - 73.5::DOUBLE)), 6) AS y,
          round(least(13, 2.6::DOUBLE + 2.2::DOUBLE * log10(greatest(1, n)) * 1.6::DOUBLE), 6) AS radius
        FROM o WHERE lon BETWEEN 73.5::DOUBLE AND 135.1::DOUBLE AND lat BETWEEN 18::DOUBLE AND 53.6::DOUBLE""",
    "loose_objects": """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN coalesce(json_extract_string(props, '$.k'), '-') ELSE '-' END AS k, event_id % 5 >= 3 AS "none" FROM events""",
    "shadow_tables": """SELECT lower(n_name) || s AS name, s IN ('_fts_data', '_fts_segments') AS shadow FROM nation, (VALUES (''), ('_fts'), ('_fts_data'), ('_fts_segments'), ('_data'), ('_fts_rows')) v(s)""",
}
