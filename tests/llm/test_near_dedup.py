"""op6: sketches against exact similarity, classes against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.cases import clashing, prose
from pyspark.sql import functions as F

from tessera.llm.dart_minhash import band_hashes, dart_sketches, shingle_cells
from tessera.llm.near_dedup import near_classes, near_duplicates, shingle_counts, similarity, sketch_rows
from tessera.llm.op6_query import op6_near_dedup


def brute_groups(rows, least=0.8):
    """(group, least id) of each (id, text), by comparing all pairs that share a shingle."""
    counts = [shingle_counts((t or "").encode(), 5) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, c in enumerate(counts):
        for s in c or ["none"]:
            holders[s].append(i)
    for members in holders.values():
        for a in members:
            for b in members:
                if a < b and find(a) != find(b) and similarity(counts[a], counts[b]) >= least:
                    parent[find(b)] = find(a)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [(find(i), best.get(find(i))) for i in range(len(rows))]


def brute_classes(rows):
    return [least for _, least in brute_groups(rows)]


def check(docs, out):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = out.collect()
    groups = brute_groups(rows)
    assert Counter((r["doc_id"], r["text"], r["class_id"]) for r in got) == Counter((d, t, c) for (d, t), (_, c) in zip(rows, groups))
    # one keeper a group; groups of different texts can have the same least id
    assert Counter(r["class_id"] for r in got if r["is_keeper"]) == Counter(c for _, c in set(groups))
    assert all(r["doc_id"] == r["class_id"] for r in got if r["is_keeper"])


def test_collision_rate_is_the_weighted_similarity():
    rng = np.random.default_rng(5)
    sets = [{f"e{i}": int(rng.integers(1, 5)) for i in range(60)}, {f"e{i}": int(rng.integers(1, 5)) for i in range(20, 80)}]
    cells, rows = [], []
    for row, weights in enumerate(sets):
        for e, w in weights.items():
            for u in range(w):
                cells.append(hash_of(e, u))
                rows.append(row)
    sketch = dart_sketches(np.array(cells, dtype=np.uint64), np.array(rows), 2, 4000)
    a, b = (Counter(s) for s in sets)
    assert abs((sketch[0] == sketch[1]).mean() - similarity(a, b)) < 0.03
    assert (sketch != 0).all()


def hash_of(e, u):
    import hashlib

    return int.from_bytes(hashlib.md5(f"{e}:{u}".encode()).digest()[:8], "little")


def test_cells():
    tokens = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9, 9], dtype=np.uint64)
    cells, rows = shingle_cells(tokens, np.array([0, 10, 10, 12]), 5)
    assert Counter(rows.tolist()) == {0: 6, 2: 1} and len(set(cells.tolist())) == 7
    sketch = dart_sketches(cells, rows, 3, 8)
    assert (sketch[1] == 0).all() and (sketch[[0, 2]] != 0).all()
    assert band_hashes(sketch, 4, 2).shape == (3, 4)


def test_awkward_rows(awkward, empty):
    check(awkward, near_duplicates(awkward))
    check(awkward, near_duplicates(clashing(awkward, ["class_id", "class_texts", "is_keeper", "size", "node", "bucket", "comp", "uid", "print", "bands", "tokens", "keeper_uid", "_uid", "_print"])))
    assert near_duplicates(empty).count() == 0


def test_chains_and_groups(spark):
    """Exact copies, drifting near copies, and texts that share a passage but are not near."""
    r = random.Random(11)
    rows, passage = [], prose(1, 60)
    for base in range(4):
        words = prose(base + 40, 150).split()
        for i in range(25):
            changed = list(words)
            for _ in range(r.randrange(4)):
                changed[r.randrange(len(changed))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
            if i % 5 == 0:
                words = changed
    rows += [(len(rows) + i, passage + " " + " ".join(f"u{i}x{j}" for j in range(50))) for i in range(40)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, near_duplicates(docs))


def test_partner_in_a_crowded_bucket(spark):
    """All texts in one bucket, at 0.7 to 0.79 but for pairs that no leader meets."""
    r, template = random.Random(3), [f"t{i}" for i in range(240)]

    def edited(words, n):
        changed = list(words)
        for at in r.sample(range(5, 235, 6), n):
            changed[at] = f"new{r.randrange(10**9)}"
        return " ".join(changed)

    texts: list[str] = []
    while len(texts) < 120:
        text = edited(template, 4)
        if all(similarity(shingle_counts(text.encode(), 5), shingle_counts(t.encode(), 5)) < 0.8 for t in texts):
            texts.append(text)
    texts += [edited(t.split(), 1) for t in texts[::20]]
    rows = list(enumerate(texts))
    counts = [shingle_counts(t.encode(), 5) for t in texts]
    near = {(a, b) for b in range(len(rows)) for a in range(b) if similarity(counts[a], counts[b]) >= 0.8}
    assert near == {(20 * i, 120 + i) for i in range(6)}
    expected = [next((a for a, b in near if b == i), i) for i in range(len(rows))]
    sketches = sketch_rows(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("bands", F.array(F.lit(7).cast("long")))
    got = {d["doc_id"]: d["class_id"] for d in sketches.join(near_classes(sketches), "print").collect()}
    assert [got[i] for i in range(len(rows))] == expected


def test_recall_in_a_large_group(spark):
    """Copies of one text with up to six of its 200 words changed: all links that brute force finds join the classes."""
    r, words = random.Random(6), prose(77, 200).split()
    texts = []
    for _ in range(300):
        changed = [w + "a" for w in words] if r.random() < 0.2 else list(words)
        for at in r.sample(range(200), r.randrange(0, 7)):
            changed[at] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(changed))
    counts = [shingle_counts(t.encode(), 5) for t in texts]
    least = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if least[a] != least[b] and similarity(counts[a], counts[b]) >= 0.8:
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == least


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    check(docs, op6_near_dedup(spark, f"/root/testdata/{sf}").join(docs, "doc_id"))
