"""Removal of lines that many documents share, in DataFrame functions only.

Lines become 128-bit hashes. The (hash, document, position) rows are
range-partitioned by hash, sorted by document and position within each hash,
and read in that order once: the first row of a hash is the occurrence that
stays, the changes of document are counted on the way. What comes back for a
document is a run-length compressed bitmap of its lines, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrays import let
from tessera.sources.columns import Carried
from tessera.sources.shared import Scratch, stage

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A null document id counts as one document with the smallest id of all.
NULL_ID = -(1 << 63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def document_number(docs: DataFrame) -> Column:
    """The id as a long; ids of other types by a hash, null below all others."""
    kind = docs.schema["doc_id"].dataType
    number = F.col("doc_id").cast("long") if isinstance(kind, T.IntegralType) else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return F.coalesce(number, F.lit(NULL_ID))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h, doc, row, pos) for each line whose key has at least ``min_chars`` code points.

    ``row`` tells documents of equal id but different text apart.
    """
    long_lines = F.filter(
        F.transform(lines_of(F.col("text")), lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(WHITE)).alias("key"))),
        lambda r: F.char_length(r["key"]) >= min_chars,
    )
    def hashed(row: Column) -> Column:
        return F.transform(long_lines, lambda r: F.struct(F.unhex(F.md5(F.translate(r["key"], UPPER, LOWER))).alias("h"), row.alias("row"), r["pos"].alias("pos")))

    # the hash of the text is made inside the array: beside it, it would be made anew, and the text copied, for every line
    lines = docs.select(document_number(docs).alias("doc"), F.explode(let(F.xxhash64("text"), hashed)).alias("line"))
    return lines.select("line.h", "doc", "line.row", "line.pos")


def shared_lines(lines: DataFrame, min_docs: int, salts: int = 64) -> DataFrame:
    """(h, n_docs, keeper) of the hashes found in at least ``min_docs`` documents.

    A hash that a third of all rows hold is spread over ``salts`` groups by
    document; each group is streamed once and yields one row, and the rows of a
    hash are then added up.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        lines.select("h", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"), "doc", "pos")
        .repartitionByRange(parts, "h", "salt")
    )
    order = Window.partitionBy("h", "salt").orderBy(F.desc("doc"), "pos")
    streamed = (
        dealt.withColumn("new_doc", F.when(F.lag("doc").over(order) == F.col("doc"), 0).otherwise(1))
        .withColumn("last", F.lead("doc").over(order).isNull())
        .withColumn("first_doc", F.first("doc").over(order))
        .withColumn("docs_so_far", F.sum("new_doc").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where("last")
    )
    return (
        streamed.groupBy("h")
        .agg(F.sum("docs_so_far").alias("n_docs"), F.max("first_doc").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )


def runs(positions: Column) -> Column:
    """Sorted distinct positions as runs (start, length): the compressed bitmap of dropped lines."""

    def over(at: Column) -> Column:
        starts = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) != p - 1))
        ends = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != p + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))

    return let(positions, over)


def positions_of(bitmap: Column) -> Column:
    return F.flatten(F.transform(bitmap, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))


def line_bitmaps(docs: DataFrame, scratch: Scratch, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, row, dropped_runs) for the documents that lose lines."""
    lines = scratch.stage(line_rows(docs, min_chars), "lines")
    # read from a table, both sides of the join are plain exchanges, so a line of very many documents can be split
    shared = scratch.stage(shared_lines(lines, min_docs).select("h", "keeper"), "shared")
    lost = lines.join(shared, "h").where(F.col("doc") < F.col("keeper"))
    return (
        lost.groupBy("doc", "row")
        .agg(F.array_sort(F.collect_set("pos")).alias("positions"))
        .select("doc", "row", runs(F.col("positions")).alias("dropped_runs"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All rows of ``docs`` with n_lines, n_dropped, dropped_runs and kept_text.

    A null or empty text is one empty line; long texts are split whole. Rows of
    equal id and text share their bitmap; rows of equal id count as one
    document, ids that are no whole numbers by a hash. Null ids count as one
    document whose id is below all others. An empty table stays empty. Columns
    of the four names above are replaced, all others pass under any name.
    """
    carried = Carried(docs, ["doc_id", "text"], ["n_lines", "n_dropped", "dropped_runs", "kept_text"])
    keyed = carried.df.withColumn("doc", document_number(carried.df)).withColumn("row", F.xxhash64("text"))
    with Scratch(docs.sparkSession) as scratch:
        marks = stage(line_bitmaps(carried.df, scratch, min_chars, min_docs), "bitmaps")
    joined = keyed.join(marks, ["doc", "row"], "left")
    lines = lines_of(F.col("text"))
    gone = positions_of(F.coalesce(F.col("dropped_runs"), F.array().cast("array<struct<start:int,length:int>>")))
    kept = let(lines, lambda split: F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone")), lambda i: F.get(split, i)))
    counted = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn("gone", gone).withColumn("n_dropped", F.size("gone").cast("long"))
    whole = F.when(F.col("n_dropped") == 0, F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return carried.back(counted.withColumn("kept_text", whole), "n_lines", "n_dropped", "dropped_runs", "kept_text")
