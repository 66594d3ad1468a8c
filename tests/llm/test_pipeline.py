"""The pipeline: stages against brute force, columns, awkward input."""

import pytest
from llm.test_edit_match import plain
from llm.test_near_dedup import brute_classes
from llm.test_quality import brute
from llm.test_sharding import jump

import corpus_pipeline
from tessera.sources.shared import stage


@pytest.fixture(scope="module")
def outputs(spark):
    base = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{base}/documents.parquet"), {}
    out["input"] = docs
    for name, function in corpus_pipeline.STAGES:
        docs = out[name] = stage(function(spark, docs, base), name)
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_stages(spark, outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    for name in ("quality_rules", "near_dedup", "decontamination", "mixing"):
        assert outputs[name].columns == outputs["input"].columns
    rows = {r["doc_id"]: r["text"] for r in outputs["input"].collect()}
    for i in ids(outputs["quality_rules"]):
        n, _, _, _, repeated = brute(rows[i])
        assert n >= 50 and 100 * repeated <= 50 * n


def test_near_dedup(outputs):
    rows = [(r["doc_id"], r["text"]) for r in outputs["quality_rules"].collect()]
    assert sorted(ids(outputs["near_dedup"])) == sorted(set(brute_classes(rows)))


def test_decontamination(spark, outputs):
    items = [plain(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = {r["doc_id"]: plain(r["text"]) for r in outputs["near_dedup"].collect()}
    assert sorted(ids(outputs["decontamination"])) == sorted(i for i, t in rows.items() if not any(x in t for x in items))


def test_mixing_keeps_clean_documents(spark, outputs):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    before, after = set(ids(outputs["decontamination"])), set(ids(outputs["mixing"]))
    clean = {i for i in before if labels.get(i) == (1, 0)}
    assert after <= before and len(clean & after) >= 0.95 * len(clean)
    assert not {i for i in after if labels.get(i, (1, 0))[1] == 1}


def test_sharding(outputs):
    rows = outputs["sharding"].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(ids(outputs["mixing"]))
    assert all(r["shard"] == jump(r["doc_id"], 16) for r in rows)


def test_run(spark, outputs):
    assert sorted(ids(corpus_pipeline.run(spark, "/root/testdata/sf0.001"))) == sorted(ids(outputs["sharding"]))


def test_awkward_and_empty(spark, awkward, empty):
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, awkward, "/root/testdata/sf0.001")
        assert set(awkward.columns) <= set(out.columns) and out.count() <= awkward.count()
        assert function(spark, empty, "/root/testdata/sf0.001").count() == 0
