"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

The shard of a row depends on its key and the number of shards alone. There is
no ring table, and going from n to n + 1 shards moves only the rows that land
in the new shard, 1 / (n + 1) of them in expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.columns import Carried

#: Multiplier of the 64-bit linear congruential generator of the published algorithm.
LCG = 2862933555777941757
MASK32 = 0xFFFFFFFF
#: Jumps that are computed for each row before the (practically unused) exact tail.
USUAL_JUMPS = 64
#: Offsets that are broadcast at most: shards times buckets.
MOST_OFFSETS = 1 << 18
NEW_COLUMNS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _low32(a: Column, b0: int, b1: int) -> Column:
    """Low bits of ``a`` times the 32-bit constant b1 * 2**16 + b0, without overflowing a long."""
    return a * b0 + F.shiftleft((a * b1).bitwiseAND(0xFFFF), 16)


def _step(state: Column) -> Column:
    """One draw of the generator and the jump that follows from it.

    The 64-bit state is kept as two 32-bit halves, since a product of longs
    raises an overflow error in ANSI mode instead of wrapping.
    """
    a0, a1, a2, a3 = (LCG >> s & 0xFFFF for s in (0, 16, 32, 48))
    hi, lo, j = state["hi"], state["lo"], state["j"]
    p1 = lo * a1
    t = lo * a0 + 1 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(t, 32) + F.shiftright(p1, 16)
    new_hi = (carry + _low32(lo, a2, a3) + _low32(hi, a0, a1)).bitwiseAND(MASK32)
    jump = ((j + 1) * (F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + 1))).cast("long")
    return F.struct(j.alias("b"), jump.alias("j"), new_hi.alias("hi"), t.bitwiseAND(MASK32).alias("lo"))


def jump_state(key: Column, shards: int) -> Column:
    """Struct with ``b``, the shard of the 64-bit ``key`` among ``shards``, and ``j``, the shard it would jump to next."""
    start = F.struct(
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(MASK32).alias("lo"),
    )

    def run(first: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda s, _: F.when(s["j"] < shards, _step(s)).otherwise(s))

    usual = run(start, min(shards, USUAL_JUMPS))
    if shards <= USUAL_JUMPS:
        return usual
    return F.when(usual["j"] < shards, run(usual, shards)).otherwise(usual)


def shard_key(df: DataFrame, column: str) -> Column:
    """A 64-bit key: integers as they are, other types by hash; null counts as 0."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long"))
    return F.when(F.col(column).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(column)))


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Add ``shard`` and ``grown_shard``, the shard once one more shard is appended.

    Rows with equal keys share a shard; null keys all go to the shard of key 0.
    An empty table stays empty. Existing columns of these two names are replaced; shard_state is a working name.
    """
    return (
        df.withColumn("shard_state", jump_state(shard_key(df, key), shards))
        .withColumn("shard", F.col("shard_state.b").cast("int"))
        .withColumn("grown_shard", F.when(F.col("shard_state.j") == shards, F.lit(shards)).otherwise(F.col("shard_state.b")).cast("int"))
        .drop("shard_state")
    )


def number_slots(df: DataFrame, order: list[str], shards: int, buckets: int = 1024) -> DataFrame:
    """Add ``slot``, gapless from 0 within each ``shard``; columns that begin with slot_ are working names.

    A shard can hold a sixteenth of the corpus, so it is never one window
    partition: its rows are spread over ``buckets`` by a checksum of the
    ``order`` columns, numbered within their bucket, and moved up by the sizes
    of the buckets before it. Those sizes are broadcast while they are at most
    MOST_OFFSETS rows, some MB: many shards have fewer buckets each, and more
    shards than that are joined with their sizes by an exchange. Ties in ``order`` are rows that can't be told apart by
    it; they get consecutive slots.
    """
    buckets = max(1, min(buckets, MOST_OFFSETS // shards))
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))
    rows = df.withColumn("slot_bucket", F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("shard", "slot_bucket").agg(F.count("*").alias("slot_n"))
    before = Window.partitionBy("shard").orderBy("slot_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "slot_bucket", F.coalesce(F.sum("slot_n").over(before), F.lit(0)).alias("slot_offset"))
    within = Window.partitionBy("shard", "slot_bucket").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    return (
        rows.withColumn("slot_at", F.row_number().over(within))
        .join(F.broadcast(offsets) if shards * buckets <= MOST_OFFSETS else offsets, ["shard", "slot_bucket"])
        .withColumn("slot", F.col("slot_offset") + F.col("slot_at") - 1)
        .drop("slot_bucket", "slot_at", "slot_offset")
    )


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    A null text counts as empty (size 1, checksum 0), a null key as key 0; long
    texts count whole. Rows repeated exactly get the same shard and slots of
    their own. An empty table stays empty. Columns of the new names are
    replaced, all others pass under any name.
    """
    carried = Carried(docs, [key, text], NEW_COLUMNS)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = (
        assign_shards(carried.df, key, shards)
        .withColumn("size", (F.octet_length(body) + 1).cast("long"))
        .withColumn("text_crc32", F.crc32(body.cast("binary")))
        .withColumn("law", F.lit("key"))
    )
    return carried.back(number_slots(rows, [key, "text_crc32", "size"], shards), *NEW_COLUMNS)
