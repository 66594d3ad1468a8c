"""op8: posteriors on held-out labels, rates against a dense solver."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm.cases import clashing
from pyspark.sql import functions as F

from tessera.llm.mixing import DOMAINS, HEAD_SHARES, TARGETS, UNIT, fit_rates, fitted, mix_sources, rate_after
from tessera.llm.op8_query import op8_mixing


def solved(p, t, targets, top, steps=20_000):
    """Rates by the same objective with many more steps, and the objective."""
    base = (t[:, None] * p).sum(axis=0)
    goal = base[0] / targets["clean"] * np.array([targets[d] for d in DOMAINS])
    x = np.ones(len(t))
    for _ in range(steps):
        x = np.clip(x - p @ ((t @ (p * x[:, None]) - goal) / np.where(base > 0, base, np.inf)), 0, top)
    return x, lambda v: (((t @ (p * v[:, None]) - goal) ** 2) / np.maximum(base, 1)).sum()


def test_rates_against_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    p = np.array([rng.multinomial(UNIT, rng.dirichlet([0.3, 0.3, 0.3])) for _ in range(200)])
    t = rng.integers(5, 500, 200)
    targets = {"clean": 0.8, "toxic": 0.05, "junk": 0.15}
    scored = spark.createDataFrame([(i, int(n), *map(int, q)) for i, (n, q) in enumerate(zip(t, p))], "i long, n_tokens long, clean long, toxic long, junk long")
    for top in (1.0, 3.0):
        got = np.array([r["x"] for r in scored.select("i", rate_after(fit_rates(scored, targets, top), top).alias("x")).orderBy("i").collect()])
        x, loss = solved(p / UNIT, t, targets, top)
        assert (got >= 0).all() and (got <= top).all()
        assert loss(got) <= loss(x) + 1e-3 * loss(np.ones(200))


def test_query_against_brute_force(spark):
    """Features by regular expressions, posteriors by numpy, rates by a dense solver, copies by the published hash."""
    base = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{base}/labels.parquet")
    model = fitted(docs, labels)
    rows = op8_mixing(spark, base).join(docs, "doc_id").collect()
    for r in rows:
        low = (r["text"] or "").lower()
        words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f\s]+", low) if w]
        held = {*words} | {"\t" + s[-2:] for s in re.findall(r"[!-/:-@\[-`{-~]+", low)}
        logits = model.intercepts + sum((model.coefficients[:, i] for t, i in model.index[0].items() if t in held), np.zeros(3))
        heads = Counter(w[:5] for w in words)
        for index, share in zip(model.index[1:], HEAD_SHARES):
            logits = logits + sum((model.coefficients[:, i] for h, i in index.items() if heads[h] and heads[h] >= share * len(words)), np.zeros(3))
        p = np.exp(logits - logits.max())
        assert np.abs(p / p.sum() - [r[f"p_{d}"] for d in DOMAINS]).max() < 3 / UNIT
        assert r["n_tokens"] == len((r["text"] or "").encode().split())
        seed = xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little", signed=True), 42)
        drawn = xxhash.xxh64_intdigest(r["text"].encode(), seed) % (1 << 30) / (1 << 30)
        assert r["copies"] == int(r["rate"] + drawn)
    got = np.array([r["rate"] for r in rows])
    x, loss = solved(np.array([[r[f"p_{d}"] for d in DOMAINS] for r in rows]), np.array([r["n_tokens"] for r in rows]), TARGETS, 5.0, 5_000)
    # the fit ends once a step moves no total by a ten-thousandth of all words
    assert loss(got) <= loss(x) + 5e-3 * loss(np.ones(len(rows)))


def test_targets_are_met(spark):
    rows = op8_mixing(spark, "/root/testdata/sf0.01").where("n_tokens > 0")
    shares = rows.agg(*(F.sum(F.expr(f"n_tokens * p_{d} * rate")).alias(d) for d in DOMAINS)).first()
    total = sum(shares)
    assert shares["clean"] / total > 0.95 and shares["toxic"] / total < 0.02


@pytest.mark.parametrize("junk", [500, 12])
def test_copies_meet_the_targets(spark, tmp_path, junk):
    """Junk above its target, where it holds a third of all words, and below it."""
    words = {0: "good", 2: "junk"}
    rows = [(i, " ".join(f"{words[2 if i >= 1000 else 0]}{(i * 7 + j * 13) % 40}" for j in range(50))) for i in range(1000 + junk)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op8_mixing(spark, str(tmp_path)).groupBy((F.col("doc_id") >= 1000).alias("junk")).agg(F.sum("n_tokens").alias("words"), F.sum(F.expr("n_tokens * copies")).alias("n")).collect()
    n = {r["junk"]: r["n"] for r in got}
    assert abs(n[False] / 50_000 - 1) < 0.02 and 0.02 < n[True] / (n[True] + n[False]) < 0.04


def test_held_out_labels(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{base}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    rows = mix_sources(docs, labels.where(half == 0)).join(labels.where(half == 1), "doc_id").groupBy("quality", "toxic").agg(F.avg("copies").alias("kept")).collect()
    kept = {(r["quality"], r["toxic"]): r["kept"] for r in rows}
    assert kept[1, 0] > 0.98 and kept[1, 1] < 0.3 and kept[0, 0] < 0.5


def test_awkward_rows(awkward, empty, labels):
    names = ["n_tokens", "p_clean", "p_toxic", "p_junk", "rate", "copies", "p", "_x", "_words", "_p", "clean", "toxic", "junk", "y"]
    for docs in (awkward, clashing(awkward, names)):
        rows = mix_sources(docs, labels).collect()
        assert len(rows) == awkward.count()
        for r in rows:
            assert abs(r["p_clean"] + r["p_toxic"] + r["p_junk"] - 1) < 1e-9
            assert 0 <= r["rate"] <= 1 and r["copies"] in (0, 1)
            assert r["n_tokens"] == len((r["text"] or "").encode().split())
    assert mix_sources(empty, labels).count() == 0
    for few in (labels.limit(0), labels.where("doc_id = 0")):
        assert mix_sources(awkward, few).count() == awkward.count()
