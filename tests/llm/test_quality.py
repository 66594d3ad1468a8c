"""op5: base counts by brute force, the ratio by hand, verdicts on held-out labels."""

import math
import re
from collections import Counter

import numpy as np
from llm.cases import clashing
from pyspark.sql import functions as F

from tessera.llm.op5_query import op5_quality_rules
from tessera.llm.quality import BUCKETS, COLUMNS, FEATURES, GRAMS, gram_buckets, ratio_table, score_documents
from tessera.llm.tokens import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        n_words, _, _, _, repeated = counts = brute(r["text"])
        assert tuple(r[c] for c in FEATURES) == counts
        assert r["base_failed"] == (n_words < 50 or 100 * repeated > 50 * n_words)
        assert r["kept"] in (True, False) and not (r["kept"] and r["base_failed"])


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_quality_rules(spark, sf_dir).collect()
    check([{**r.asDict(), "text": texts[r["doc_id"]]} for r in rows], texts)


def brute_verdicts(texts, labels):
    """(score, kept) of each document, from n-grams counted one by one and all cuts tried."""
    def buckets(text):
        raw = (text or "").encode()
        return [int(mix(np.array([int.from_bytes(raw[i : i + n], "little") + (n << 56)], dtype=np.uint64))[0]) % BUCKETS for n in GRAMS for i in range(len(raw) - n + 1)]

    grams, good = {d: buckets(t) for d, t in texts.items()}, {d for d, q, x in labels if q == 1 and not x}
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for d, found in grams.items():
        np.add.at(raw, found, 1)
        if d in good:
            np.add.at(target, found, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    score = {d: ratio[found].mean() if found else 0.0 for d, found in grams.items()}
    failed = {d for d, t in texts.items() if (c := brute(t))[0] < 50 or 100 * c[4] > 50 * c[0]}
    bins = [(math.floor(score[d] / 0.005), q == 1) for d, q, _ in labels if q is not None and d in score and d not in failed]
    n_good, n_bad = sum(g for _, g in bins), sum(not g for _, g in bins)
    gains = {b: sum(g for x, g in bins if x > b) / n_good + sum(not g for x, g in bins if x <= b) / n_bad for b, _ in bins}
    at = min(gains, key=lambda b: (-round(gains[b], 12), b))
    cut = (at + 1 + max(min((b for b in gains if b > at), default=at + 1), at + 1)) / 2 * 0.005 if gains[at] > 1 else -math.inf
    return {d: (s, d not in failed and s >= cut) for d, s in score.items()}


def test_scores_and_verdicts_against_brute_force(spark):
    base = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    labels = {(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    expected = brute_verdicts(texts, labels)
    for r in op5_quality_rules(spark, base).collect():
        score, kept = expected[r["doc_id"]]
        assert math.isclose(r["score"], score, abs_tol=1e-9) and r["kept"] == kept


def test_tiny_texts(spark):
    for text in ["", "a", "ok", "abc", "abcd", "é", "😀x"]:
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
        check(score_documents(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")).collect(), [1])
    assert len(gram_buckets(np.frombuffer(b"ok", dtype=np.uint8), np.array([0, 2]))[0]) == 1


def test_awkward_rows(awkward, empty, labels):
    check(score_documents(awkward, labels).collect(), awkward.collect())
    check(score_documents(clashing(awkward, COLUMNS), labels).collect(), awkward.collect())
    assert score_documents(empty, labels).count() == 0
    assert score_documents(awkward, labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_ratio_by_hand(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, "bé")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    counts = {"t": Counter(), "r": Counter()}
    for text, good in (("abab", True), ("bé", False)):
        raw = text.encode()
        for n in GRAMS:
            for i in range(len(raw) - n + 1):
                with np.errstate(over="ignore"):
                    b = int(mix(np.array([int.from_bytes(raw[i : i + n], "little") + (n << 56)], dtype=np.uint64))[0]) % BUCKETS
                counts["r"][b] += 1
                counts["t"][b] += good
    table = ratio_table(docs, labels)
    for b in range(0, BUCKETS, 97):
        want = math.log((counts["t"][b] + 1) / (sum(counts["t"].values()) + BUCKETS)) - math.log((counts["r"][b] + 1) / (sum(counts["r"].values()) + BUCKETS))
        assert abs(table[b] - want) < 1e-12


def test_grams_stay_in_their_text():
    data = np.frombuffer(b"abcde", np.uint8)
    _, rows = gram_buckets(data, np.array([0, 3, 3, 5]))
    assert Counter(rows.tolist()) == {0: 3, 2: 1}


def test_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    rows = score_documents(docs, labels.where(half == 0)).join(labels.where(half == 1), "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1
