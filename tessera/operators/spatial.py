"""Regions: bounding boxes, points in polygons, grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_cell(lat: Column, lon: Column, scale: int = 100) -> Column:
    """Cell of a coordinate, halves away from zero."""
    return F.struct(F.round(lat * scale).cast("int").alias("y"), F.round(lon * scale).cast("int").alias("x"))


def crossings(lon: Column, lat: Column, ring: Column) -> Column:
    """Edges of a closed ring of (lon, lat) that a ray from the point to the east crosses."""
    n = F.size(ring)

    def edge(acc: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = F.try_divide((a["lon"] - b["lon"]) * (lat - b["lat"]), a["lat"] - b["lat"]) + b["lon"]  # from the vertex before, product first
        return acc + F.when(spans & (lon < at), 1).otherwise(0)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), edge)).otherwise(0)


def in_region(lon: Column, lat: Column, polygons: Column) -> Column:
    """Whether a point lies in one of the polygons; rings after the first are holes (even-odd over all rings)."""
    return F.exists(polygons, lambda rings: F.aggregate(rings, F.lit(0), lambda s, ring: s + crossings(lon, lat, ring)) % 2 == 1)


def _edges(regions: DataFrame, tile: float) -> DataFrame:
    """The edges of all rings that span some latitude, a row for each band of tiles that they touch: id, poly, ends, band ty, columns c0 to c1."""
    polys = regions.select(F.col("id").alias("region"), F.posexplode("polygons").alias("poly", "rings"))
    rings = polys.select("region", "poly", F.explode("rings").alias("ring")).where(F.size("ring") > 0)
    # an edge goes to each vertex from the one before it, to the first from the last
    before = F.concat(F.slice("ring", -1, 1), F.slice("ring", 1, F.size("ring") - 1))
    pairs = rings.select("region", "poly", F.explode(F.arrays_zip(F.col("ring").alias("a"), before.alias("b"))).alias("e")).select("region", "poly", "e.a", "e.b")
    edges = pairs.where("a.lat <> b.lat").withColumns({"low": F.least("a.lat", "b.lat"), "high": F.greatest("a.lat", "b.lat"), "c0": F.floor(F.least("a.lon", "b.lon") / tile), "c1": F.floor(F.greatest("a.lon", "b.lon") / tile)})
    return edges.withColumn("ty", F.explode(F.sequence(F.floor(F.col("low") / tile), F.floor(F.col("high") / tile))))


def region_cells(regions: DataFrame, tile: float = 1.0) -> DataFrame:
    """(region, poly, bbox, tx, ty, toggles, edges): the tiles that polygons touch or fill, with all that tells which of their points lie inside.

    Of the ray that leaves a point to the east only the edges in columns of the tile have to be tested; these are ``edges``.
    Those further east cross it or not by its latitude alone: whether their number is odd changes at the latitudes
    ``toggles``. Where one edge ends and the next goes on from there in the same column nothing changes, so a tile has few
    of them: one of the inside has its lower side, one outside none and no row. A polygon of very many vertices is thus cut
    up, and each of its edges is held by the tiles around it only.
    """
    edges = _edges(regions, tile)
    bottom = F.greatest("low", F.col("ty") * tile)
    ends = F.array(bottom, F.when(F.col("high") < (F.col("ty") + 1) * tile, F.col("high")))
    changes = edges.select("region", "poly", "ty", "c0", F.explode(F.filter(ends, lambda y: y.isNotNull())).alias("lat"))
    # of the columns c at one latitude, sorted, each second gap is where their number further east is odd
    columns = changes.groupBy("region", "poly", "ty", "lat").agg(F.sort_array(F.collect_list("c0")).alias("c"))
    gaps = F.filter(F.transform("c", lambda x, i: F.struct(x.alias("from"), F.get("c", i + 1).alias("to"), i.alias("i"))), lambda g: (g["i"] % 2 == F.size("c") % 2) & (g["from"] < g["to"]))
    toggles = columns.select("region", "poly", "ty", "lat", F.explode(gaps).alias("g")).select("region", "poly", "ty", F.explode(F.sequence(F.col("g.from"), F.col("g.to") - 1)).alias("tx"), "lat", F.lit(None).cast("struct<a:struct<lon:double,lat:double>,b:struct<lon:double,lat:double>>").alias("edge"))
    point = lambda p: F.struct(F.col(f"{p}.lon").cast("double").alias("lon"), F.col(f"{p}.lat").cast("double").alias("lat"))
    local = edges.select("region", "poly", "ty", F.explode(F.sequence("c0", "c1")).alias("tx"), F.lit(None).cast("double").alias("lat"), F.struct(point("a").alias("a"), point("b").alias("b")).alias("edge"))
    cells = toggles.union(local).groupBy("region", "poly", "tx", "ty").agg(F.sort_array(F.collect_list("lat")).alias("toggles"), F.collect_list("edge").alias("edges"))
    boxes = regions.select(F.col("id").alias("region"), "bbox")
    return cells.join(boxes, "region").select("region", "poly", "bbox", "tx", "ty", "toggles", "edges")


def _inside(lon: Column, lat: Column) -> Column:
    """Whether a point lies inside, from the toggles and edges of its tile, and in the box of the region."""
    east = F.size(F.filter("toggles", lambda y: y <= lat))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = F.try_divide((a["lon"] - b["lon"]) * (lat - b["lat"]), a["lat"] - b["lat"]) + b["lon"]  # from the vertex before, product first
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at)

    b = F.col("bbox")
    boxed = lon.between(F.get(b, F.lit(0)), F.get(b, F.lit(2))) & lat.between(F.get(b, F.lit(1)), F.get(b, F.lit(3)))
    return boxed & ((east + F.size(F.filter("edges", crossed))) % 2 == 1)


def locate(points: DataFrame, regions: DataFrame, tile: float = 1.0) -> DataFrame:
    """``points`` with region_id, the first region (by id) that holds each point, null for none.

    Points meet the tiles of the regions (:func:`region_cells`) by hash; a point in the inside of a region is held
    against no edge, one near its border against the edges of its tile.
    """
    placed = points.withColumn("_p", F.monotonically_increasing_id()).withColumn("tx", F.floor(F.col("lon") / tile)).withColumn("ty", F.floor(F.col("lat") / tile))
    hits = placed.join(region_cells(regions, tile), ["tx", "ty"], "left").withColumn("_hit", F.when(_inside(F.col("lon"), F.col("lat")), F.col("region")))
    return hits.groupBy("_p", *points.columns).agg(F.min("_hit").alias("region_id")).drop("_p")
