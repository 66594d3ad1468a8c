"""op9 against a dictionary model, and weights against a plain EM."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera.llm.interpolated_lm as lm
from tessera.llm.op9_query import op9_lm_scoring


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def model(rows):
    """Counts and weights on Python dictionaries, the same EM."""
    texts = [((t or "").encode().lower().split() + [b"\0end"], fold(i)) for i, t in rows]

    def counts(wanted):
        one, two = Counter(), Counter()
        for t, f in texts:
            if wanted(f):
                one.update(t)
                two.update(zip([b"\0end"] + t, t))
        return one, two

    one, two = counts(lambda f: f != 2)
    left1, left2 = counts(lambda f: f not in (2, 3))
    total, vocabulary = sum(one.values()), len(one)
    weights = np.full((lm.CONTEXT_BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]

    def parts(v, w, c1, c2):
        return np.array([c2[v, w] / max(c1[v], 1), c1[w] / max(total, 1), 1 / (vocabulary + 1)])

    seen = [(min(math.frexp(left1[v])[1], 47), parts(v, w, left1, left2)) for t, f in texts if f == 3 for v, w in zip([b"\0end"] + t, t)]
    for _ in range(lm.EM_STEPS):
        sums = np.zeros_like(weights)
        for b, p in seen:
            share = p * weights[b]
            sums[b] += share / share.sum()
        new = (sums + weights) / (sums + weights).sum(axis=1, keepdims=True)
        done = np.abs(new - weights).max() < 1e-4
        weights = new
        if done:
            break
    weights = np.maximum(weights, lm.FLOOR)
    weights[0, 0] = 0
    weights /= weights.sum(axis=1, keepdims=True)
    out = []
    for (i, _), (t, f) in zip(rows, texts):
        base = sum(math.log10((one[w] + 1) / (total + 1 * (vocabulary + 1))) for w in t)
        score = sum(math.log10((parts(v, w, one, two) * weights[min(math.frexp(one[v])[1], 47)]).sum()) for v, w in zip([b"\0end"] + t, t))
        out.append((i, f == 2, len(t), sum(one[w] > 0 for w in t), total, base, score))
    return out


def check(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert tuple(g[:5]) == tuple(w[:5])
        assert g[5:] == pytest.approx(w[5:], rel=1e-6)


def score(df):
    f = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    part = F.when(f == 2, lm.HELD_OUT).when(f == 3, lm.DELETED).otherwise(lm.TRAIN)
    rows = lm.score_corpus(df, part).collect()
    return [tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in rows]


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check([tuple(r) for r in op9_lm_scoring(spark, sf_dir).collect()], model(rows))


@pytest.mark.parametrize("block", [7, 500, 10**6])
def test_awkward_rows_in_blocks_of_any_size(awkward, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    small = awkward.where("doc_id is null or doc_id <> 26")
    check(score(small), model([(r["doc_id"], r["text"]) for r in small.collect()]))


def test_long_text_empty_table_and_no_training(spark, awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check(score(awkward), model(rows))
    assert score(empty) == []
    held = spark.createDataFrame([(i, "a b") for i in range(40) if fold(i) == 2], "doc_id long, text string")
    check(score(held), model([(r["doc_id"], r["text"]) for r in held.collect()]))


def test_packing():
    for values in ([], [0], [1, 2**31], [2**32, 5], [2**63 + 1]):
        assert lm.unpack(lm.pack(np.array(values, dtype=np.uint64))).astype(np.uint64).tolist() == values
