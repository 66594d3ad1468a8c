"""op1 against the published algorithm and its law."""

import zlib
from collections import Counter, defaultdict

import pytest
from llm.cases import clashing
from pyspark.sql import functions as F

from tessera.llm.op1_query import op1_sharding
from tessera.llm.sharding import assign_shards, jump_state, shard_documents


def jump(key: int, shards: int) -> int:
    """Lamping and Veach, 2014, on Python integers."""
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 100, 1000])
def test_published_values(spark, shards):
    keys = [0, 1, 2, -1, 256, 10**12, 2**63 - 1, -(2**63), *range(1000, 1100)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["b"] for r in df.select("k", jump_state(F.col("k"), shards)["b"].alias("b")).collect()}
    assert got == {k: jump(k, shards) for k in keys}


def test_growth_moves_rows_to_the_new_shard_only(spark):
    rows = assign_shards(spark.range(20000), "id", 16).collect()
    assert all(r["grown_shard"] == jump(r["id"], 17) and r["grown_shard"] in (r["shard"], 16) for r in rows)
    assert 0.04 < sum(r["grown_shard"] == 16 for r in rows) / len(rows) < 0.08


def check(rows, docs):
    slots = defaultdict(list)
    for r in rows:
        body = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 1, zlib.crc32(body), "key")
        assert r["shard"] == jump(r["doc_id"] or 0, 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((d["doc_id"], d["text"]) for d in docs)


def test_awkward_rows(awkward, empty):
    check(shard_documents(awkward).collect(), awkward.collect())
    check(shard_documents(clashing(awkward, ["shard", "slot", "size", "law", "grown_shard", "text_crc32"])).collect(), awkward.collect())
    assert shard_documents(empty).count() == 0


@pytest.mark.parametrize("shards", [300, 5000, (1 << 18) + 1])
def test_any_number_of_shards(spark, shards):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    slots = defaultdict(list)
    for r in shard_documents(docs, shards).collect():
        assert r["shard"] == jump(r["doc_id"], shards)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(op1_sharding(spark, sf_dir).join(docs.select("doc_id", "text"), "doc_id").collect(), docs.collect())


def test_string_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string")
    rows = assign_shards(df, "k", 8).collect()
    assert len({r["shard"] for r in rows if r["k"] == "a"}) == 1
