"""Operators against brute force and hand-built cases."""

import math
import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources.shared import arrow_batches
from tessera.operators import clustering, duplicates, filters, graph, merge, numbering, order_statistics, prefixes, ranking, similarity, spatial, sql_guard


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")


def test_relative_rank_fixture(spark):
    rows = [(1.0, 0.0), (0.6, 0.8), (0.4, math.sqrt(0.84)), (0.2, math.sqrt(0.96)), (0.0, 1.0)]
    v = vectors_of(spark, rows)
    assert [r["vec_id"] for r in ranking.rank_relative(v, [1.0, 0.0], 10, 0.1999).collect()] == [0, 1]
    assert ranking.rank_relative(v, [1.0, 0.0], 10, 0.2, min_lift=0.61).count() == 0


def test_fold(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert [r["vec_id"] for r in ranking.rank_relative(v, [1.0, 0.0], 10, 0.0, per_group=2, group="label").collect()] == [0, 1]


@pytest.mark.parametrize("few", [4096, 1])
def test_median_and_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(order_statistics, "FEW", few)
    values = [random.Random(5).uniform(-1, 1) for _ in range(501)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    s = sorted(values)
    assert order_statistics.median(df, "x") == s[250]
    assert order_statistics.nearest_rank(df, "x", [0, 0.9, 1]) == [s[0], s[450], s[500]]
    assert order_statistics.median(df.limit(0), "x") == 0.0
    odd = spark.createDataFrame([(x,) for x in [3.0] * 300 + [-1e300, 1e300, 3.0000000000000004, None, float("nan"), float("inf"), float("-inf")]], "x double")
    assert order_statistics.values_at(odd, "x", [0, 1, 2, 150, 302, 303, 304]) == [float("-inf"), -1e300, 3.0, 3.0, 3.0000000000000004, 1e300, float("inf")]


def test_numbered(spark):
    r = random.Random(2)
    rows = [(r.choice("aaaaab"), r.random(), i) for i in range(500)] + [(None, 0.5, 500)]
    df = spark.createDataFrame(rows, "g string, x double, i long").repartition(7)
    for group in ([], ["g"]):
        got = {t["i"]: t["p"] for t in numbering.numbered(df, group, ["x", "i"], "p").collect()}
        seen: dict = {}
        for g, _, i in sorted(rows, key=lambda t: t[1:]):
            assert got[i] == seen.get(g if group else 0, 0)
            seen[g if group else 0] = got[i] + 1


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_similar_pairs_lose_nothing(spark, least):
    r = random.Random(7)
    rows = []
    for _ in range(60):
        v = [r.gauss(0, 1) for _ in range(4)]
        n = math.sqrt(sum(x * x for x in v))
        rows.append([x / n for x in v])
    expected = {(i, j) for i, j in combinations(range(60), 2) if sum(a * b for a, b in zip(rows[i], rows[j])) >= least}
    assert {(p["a"], p["b"]) for p in similarity.similar_pairs(vectors_of(spark, rows), least).collect()} == expected


def clustered(r, centres, each, noise, dims):
    rows = []
    for _ in range(centres):
        c = [r.gauss(0, 1) for _ in range(dims)]
        for _ in range(each):
            v = [x + noise * r.gauss(0, 1) for x in c]
            n = math.sqrt(sum(x * x for x in v))
            rows.append([x / n for x in v])
    return rows


@pytest.mark.parametrize("least, noise", [(0.9, 0.1), (0.9, 0.35), (0.5, 0.6), (-0.2, 1.0)])
def test_similar_pairs_with_many_pivots(spark, monkeypatch, least, noise):
    """Every pair once, from cells of a few vectors; copies of a vector and vectors that are not of length 1 among them."""
    monkeypatch.setattr(similarity, "BLOCK", 5)
    rows = clustered(random.Random(int(100 * noise)), 25, 6, noise, 8)
    rows += [rows[0]] * 4 + [[0.5 * x for x in rows[9]], [1.5 * x for x in rows[20]]]
    expected = {(i, j) for i, j in combinations(range(len(rows)), 2) if sum(a * b for a, b in zip(rows[i], rows[j])) >= least}
    got = [(p["a"], p["b"]) for p in similarity.similar_pairs(vectors_of(spark, rows), least).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_few_blocks_meet(spark, monkeypatch):
    """Of vectors in 40 clusters, at 0.9, the products made are a small part of all pairs."""
    monkeypatch.setattr(similarity, "BLOCK", 25)
    rows = clustered(random.Random(3), 40, 50, 0.1, 32)
    met = similarity.block_meetings(vectors_of(spark, rows), 0.9).select(F.sum(F.size("left") * F.size("right"))).first()[0]
    assert met < 0.25 * len(rows) ** 2 / 2


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_vectors_without_neighbourhoods(spark, monkeypatch, least):
    """Of vectors that are guests nearly everywhere the blocks of one cell meet: no vector is sent more often than there are blocks."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    r = random.Random(11)
    rows = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in ([r.gauss(0, 1) for _ in range(24)] for _ in range(300))]
    rows += rows[:5]
    df = vectors_of(spark, rows)
    met = similarity.block_meetings(df, least).select(F.sum(F.size("left") * F.size("right"))).first()[0]
    assert met < 0.65 * len(rows) ** 2
    near = {(i, j) for i, j in combinations(range(len(rows)), 2) if sum(a * b for a, b in zip(rows[i], rows[j])) >= least}
    got = [(p["a"], p["b"]) for p in similarity.similar_pairs(df, least).collect()]
    assert len(got) == len(near) and set(got) == near
    links = {i: sum(i in p for p in near) for i in range(len(rows))}
    found = {x["id"]: (x["class"], x["links"]) for x in similarity.similar_classes(df, least).collect()}
    assert {i: n for i, (_, n) in found.items()} == links
    assert all(found[i][0] == found[j][0] <= min(i, j) for i, j in near)


def held_at_most(work) -> int:
    """Bytes that numpy holds at most while ``work`` is done; what it yields is let go."""
    tracemalloc.start()
    for _ in work:
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_guests_are_dealt_in_small_parts():
    """10,000 vectors that are guests in nearly all of 400 cells: they are counted in slices and dealt out in batches of a bounded size."""
    r = np.random.default_rng(5)
    vectors = r.normal(size=(10_000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    batch = pa.RecordBatch.from_pydict({"id": np.arange(len(vectors)), "embedding": list(vectors.astype(np.float32))})
    counts = {}
    for out in similarity._homes(vectors[:400], 1.1)([batch]):
        for x in out.to_pylist():
            counts[x["cell"], x["home"]] = counts.get((x["cell"], x["home"]), 0) + x["n"]
    assert sum(n for (_, home), n in counts.items() if home) == len(vectors)
    dealt = 0
    for out in similarity._celled(vectors[:400], 1.1)([batch]):
        assert len(out) <= similarity.GUESTS
        dealt += len(out)
    assert dealt == sum(counts.values()) > 100 * len(vectors)
    assert held_at_most(similarity._homes(vectors[:400], 1.1)([batch])) < 60e6
    assert held_at_most(similarity._celled(vectors[:400], 1.1)([batch])) < 60e6


def test_what_is_sent_grows_slowly(spark, monkeypatch):
    """Where all blocks meet, 2,000 vectors are sent 17 times each, whatever the base size of a block."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    r = np.random.default_rng(6)
    rows = r.normal(size=(2000, 24))
    df = vectors_of(spark, (rows / np.linalg.norm(rows, axis=1)[:, None]).tolist())
    assert similarity.block_meetings(df, 0.5).count() == 16 * 17 // 2


def test_a_block_meets_itself_in_another_order():
    """The two sides of a block are gathered apart, so their orders may differ; each pair still counts once, with its own ids."""
    v = {1: [1.0, 0.0], 2: [0.9, 0.1], 3: [0.0, 1.0]}
    side = lambda ids: [[{"id": i, "embedding": v[i]} for i in ids]]
    batch = pa.RecordBatch.from_pydict({"left": side([1, 2, 3]), "right": side([3, 1, 2]), "same": [True]})
    assert [(r["a"], r["b"]) for out in similarity._matched(0.5)([batch]) for r in out.to_pylist()] == [(1, 2)]
    assert [(r["id"], r["met"], r["links"]) for out in similarity._linked(0.5)([batch]) for r in out.to_pylist()] == [(1, 1, 1), (2, 1, 1)]


def test_one_link_row_a_vector_and_meeting(monkeypatch):
    """Of a thousand copies, a meeting leaves a row for each and not one for each pair."""
    side = lambda start: [[{"id": i, "embedding": [1.0, 0.0]} for i in range(start, start + 500)]]
    batch = pa.RecordBatch.from_pydict({"left": side(0), "right": side(500), "same": [False]})
    got = [r for out in similarity._linked(0.5)([batch]) for r in out.to_pylist()]
    assert len(got) == 1000 and {r["met"] for r in got} == {0} and {r["links"] for r in got} == {500}


def test_a_meeting_of_large_blocks_holds_a_tile():
    """Two blocks of 6,000 copies, 36 million links, are told in bounded memory."""
    side = lambda start: [[{"id": i, "embedding": [1.0, 0.0]} for i in range(start, start + 6000)]]
    batch = pa.RecordBatch.from_pydict({"left": side(0), "right": side(6000), "same": [False]})
    assert held_at_most(similarity._linked(0.5)([batch])) < 60e6
    assert held_at_most(similarity._matched(0.5)([batch])) < 60e6


def test_classes_meet_over_few_ids(spark, monkeypatch):
    """The graph of the classes has the ids that meetings lead to, not an edge for each vector and meeting."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    edges, plain = [], similarity.components
    monkeypatch.setattr(similarity, "components", lambda links: edges.append(links.count()) or plain(links))
    r = random.Random(12)
    df = vectors_of(spark, [[1.0, 0.1 * r.random(), 0.1 * r.random()] for _ in range(300)] + [[-1.0, 0.0, 0.0]])
    got = {x["id"]: (x["class"], x["links"]) for x in similarity.similar_classes(df, 0.5).collect()}
    assert got == {i: (0, 299) for i in range(300)} | {300: (300, 0)}
    assert edges[0] < 40


def test_links_anyhow_are_settled_in_turn(spark, monkeypatch):
    """Where rounds over all stretches do not settle, later stretches are settled once each: few rounds over all of them."""
    monkeypatch.setattr(similarity, "STRETCH", 8)
    rounds, plain = [], similarity.stage
    monkeypatch.setattr(similarity, "stage", lambda df, name: rounds.append(name) or plain(df, name))
    r = random.Random(9)
    links = [(a, b) for a, b in combinations(range(200), 2) if r.random() < 0.4]
    got = similarity.complete_linkage(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(x["seed"], x["node"]) for x in got} == linked_in_turn(links)
    assert rounds.count("settled") <= 6


def test_similar_classes(spark):
    rows = [[1.0, 0.0], [1.0, 0.0], [0.8, 0.6], [0.0, 1.0], None, [0.6, 0.8], [-1.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["id"]: (r["class"], r["links"]) for r in similarity.similar_classes(df, 0.79).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 3), 3: (0, 1), 5: (0, 2), 4: (4, 0), 6: (6, 0)}


def linked_in_turn(links):
    """Complete linkage, one node after the other."""
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order = sorted(near, key=lambda u: (-len(near[u]), u))
    free, out = set(near), set()
    for seed in order:
        if seed in free:
            members = [seed]
            for v in order:
                if v in free and v != seed and all(v in near[m] for m in members):
                    members.append(v)
            free -= set(members)
            out |= {(seed, m) for m in members if len(members) > 1}
    return out


def test_linkage_rounds_do_not_grow_with_the_component(spark, monkeypatch):
    """Groups of twenty in one chain: 800 nodes in 50 stretches are settled in a few rounds."""
    monkeypatch.setattr(similarity, "STRETCH", 16)
    rounds, plain = [], similarity.stage
    monkeypatch.setattr(similarity, "stage", lambda df, name: rounds.append(name) or plain(df, name))
    links = [(20 * g + i, 20 * g + j) for g in range(40) for i in range(20) for j in range(i)] + [(20 * g + 19, 20 * g + 20) for g in range(39)]
    got = similarity.complete_linkage(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(x["seed"], x["node"]) for x in got} == linked_in_turn(links)
    assert rounds.count("settled") <= 8


def test_complete_linkage(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (10, 11)], "a long, b long")
    groups = {}
    for r in similarity.complete_linkage(pairs).collect():
        groups.setdefault(r["seed"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [10, 11]]
    assert similarity.complete_linkage(pairs.limit(0)).count() == 0


@pytest.mark.parametrize("stretch, nodes, tries", [(2048, 120, 500), (9, 120, 500), (5, 40, 1500), (3, 200, 150)])
def test_complete_linkage_against_a_sequence(spark, monkeypatch, stretch, nodes, tries):
    monkeypatch.setattr(similarity, "STRETCH", stretch)
    r = random.Random(4)
    links = {(a, b) for a, b in ((r.randrange(nodes), r.randrange(nodes)) for _ in range(tries)) if a < b}
    expected = linked_in_turn(links)
    got = similarity.complete_linkage(spark.createDataFrame(sorted(links), "a long, b long")).collect()
    assert len(got) == len(expected) and {(x["seed"], x["node"]) for x in got} == expected


@pytest.mark.parametrize("stretch", [16, 50, 1000])
def test_complete_linkage_of_vectors(spark, monkeypatch, stretch):
    """From the vectors alone, no table of links: a group of copies larger than a stretch, two components, vectors without a link and without numbers."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "STRETCH", 8)
    monkeypatch.setattr(similarity, "VECTORS", stretch)
    monkeypatch.setattr(similarity, "similar_pairs", None)
    r = random.Random(13)
    rows = [[x / math.sqrt(sum(y * y for y in v)) for x in v] + [0.0] for v in ([r.gauss(0, 1) for _ in range(8)] for _ in range(150))]
    rows += [rows[3]] * 40 + [[0.0] * 8 + [x] for x in (1.0, 1.0, 0.9, -0.5)]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sum(x * y for x, y in zip(rows[a], rows[b])) >= 0.4]
    df = vectors_of(spark, rows).union(spark.createDataFrame([(900, None), (901, [1.0])], "vec_id long, embedding array<double>"))
    got = similarity.complete_linkage_of_vectors(df, 0.4).collect()
    expected = linked_in_turn(links)
    assert len(got) == len(expected) and {(x["seed"], x["node"]) for x in got} == expected
    assert max(Counter(x["seed"] for x in got).values()) > 40


def test_few_or_thin_links_are_taken_as_pairs(spark, monkeypatch):
    asked, plain = [], similarity.similar_pairs
    monkeypatch.setattr(similarity, "similar_pairs", lambda *x: asked.append(1) or plain(*x))
    rows = clustered(random.Random(3), 40, 3, 0.1, 32)
    for stretch, scarce in ((2048, 1024), (8, 0)):
        monkeypatch.setattr(similarity, "STRETCH", stretch)
        monkeypatch.setattr(similarity, "SCARCE", scarce)
        assert similarity.complete_linkage_of_vectors(vectors_of(spark, rows), 0.9).count() == 120
    assert len(asked) == 2
    monkeypatch.setattr(similarity, "SCARCE", 1024)
    assert similarity.complete_linkage_of_vectors(vectors_of(spark, rows), 0.9).count() == 120
    assert similarity.complete_linkage_of_vectors(vectors_of(spark, rows), 2.0).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_nearest_centroid(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    r = random.Random(8)
    rows = [[r.randint(-3, 3) for _ in range(3)] for _ in range(50)] + [None, [1, 2]]
    asked = [[r.randint(-3, 3) for _ in range(3)] for _ in range(30)] + [None]
    df = spark.createDataFrame([(i, v and [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    centroids = spark.createDataFrame([(i, v and [float(x) for x in v]) for i, v in enumerate(asked)], "label long, centroid array<double>")
    expected = {}
    for i, v in enumerate(rows):
        best = max(((sum(a * b for a, b in zip(v, c)), -j) for j, c in enumerate(asked) if c), default=None) if v else None
        expected[i] = (-best[1] if best and best[0] >= 4 else None, best and best[0])
    assert {x["vec_id"]: (x["label"], x["sim"]) for x in similarity.nearest_centroid(df, centroids, 4.0).collect()} == expected
    named = centroids.withColumn("label", F.format_string("c%03d", "label"))
    got = similarity.nearest_centroid(df.withColumn("vec_id", F.concat(F.lit("v"), "vec_id")), named, 4.0).collect()
    assert {x["vec_id"]: (x["label"], x["sim"]) for x in got} == {f"v{i}": (label if label is None else f"c{label:03d}", sim) for i, (label, sim) in expected.items()}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 540)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["comp"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fusion_order(spark):
    kw = spark.createDataFrame([("k", 0)], "path string, rank int")
    img = spark.createDataFrame([("i", 0)], "path string, rank int")
    desc = spark.createDataFrame([("d", 0)], "path string, rank int")

    def order(kind):
        return [r["path"] for r in ranking.fuse({"kw": kw, "img": img, "desc": desc}, kind, "path").orderBy("place").collect()]

    assert order("object") == ["k", "i", "d"]
    assert order("date") == ["k", "d", "i"]


def test_owners_of_nested_roots(spark):
    roots = spark.createDataFrame([(1, "/alb/a"), (2, "/alb/a/sub"), (3, "/alb/ab")], "id long, root string")
    files = spark.createDataFrame([("/alb/a/x.jpg",), ("/alb/a/sub/y.jpg",), ("/alb/ab/z.jpg",), ("/other/w.jpg",)], "path string")
    got = {}
    for r in prefixes.owners(files, roots).collect():
        got.setdefault(r["path"], set()).add(r["root_id"])
    assert got == {"/alb/a/x.jpg": {1}, "/alb/a/sub/y.jpg": {1, 2}, "/alb/ab/z.jpg": {3}}
    longest = {r["path"]: r["owner_id"] for r in prefixes.longest_owner(files, roots).collect()}
    assert longest == {"/alb/a/x.jpg": 1, "/alb/a/sub/y.jpg": 2, "/alb/ab/z.jpg": 3, "/other/w.jpg": None}


def test_keeper_order(spark):
    rows = [("d", "/a", "/a/1", 100, 1920 * 1440, 1), ("d", "/b", "/b/2", 2_400_000, 4032 * 3024, 1), ("d", "/c", "/c/3", 6_000_000, 4032 * 3024, 2)]
    groups = spark.createDataFrame(rows, "digest string, dir string, path string, size long, pixels long, modified long")
    assert duplicates.keepers(groups).first()["keep_path"] == "/c/3"
    assert [r["path"] for r in duplicates.ranked_members(groups).orderBy("place").collect()] == ["/c/3", "/b/2", "/a/1"]
    assert {r["path"] for r in duplicates.deletable(groups).collect()} == {"/a/1", "/b/2"}


@pytest.mark.parametrize("owns, new, expected", [(True, None, None), (True, "n", "n"), (False, None, "o"), (False, "n", "n")])
def test_ownership(spark, owns, new, expected):
    old = spark.createDataFrame([(1, "o")], "id long, label string")
    fresh = spark.createDataFrame([(1, new, owns)], "id long, label string, owns boolean")
    assert merge.upsert_owned(old, fresh, "id", {"owns": ["label"]}).first()["label"] == expected


def test_insert_or_ignore_and_slices(spark):
    old = spark.createDataFrame([(1, "a")], "id long, v string")
    new = spark.createDataFrame([(1, "x"), (2, "z"), (2, "y")], "id long, v string")
    assert sorted(map(tuple, merge.insert_or_ignore(old, new, ["id"]).collect())) == [(1, "a"), (2, "y")]
    assert sorted(map(tuple, merge.upsert(old, new.where("id = 1"), ["id"]).collect())) == [(1, "x")]
    assert sorted(map(tuple, merge.replace_slice(old, new.where("id = 2"), "id", 1).collect())) == [(2, "y"), (2, "z")]


def test_suppression(spark):
    rows = [("i", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("i", 2, 1.0, 1.0, 10.0, 10.0, 0.8), ("i", 3, 20.0, 20.0, 30.0, 30.0, 0.8), ("i", 4, 5.0, 5.0, 5.0, 5.0, 0.7)]
    boxes = spark.createDataFrame(rows, "image string, id long, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r["id"] for r in clustering.non_maximum_suppression(boxes).collect()) == [1, 3, 4]


def test_sequences_longer_than_a_batch(spark):
    r = random.Random(6)
    boxes = [(r.choice("ppppq"), i, r.uniform(0, 40), r.uniform(0, 40), 0.0, 0.0, round(r.random(), 1)) for i in range(300)]
    boxes = [(p, i, x, y, x + r.uniform(0, 9), y + r.uniform(0, 9), s) for p, i, x, y, _, _, s in boxes]

    def overlap(a, b):
        sides = [max(0.0, min(a[i + 4], b[i + 4]) - max(a[i + 2], b[i + 2])) for i in (0, 1)]
        areas = [(c[4] - c[2]) * (c[5] - c[3]) for c in (a, b)]
        return sides[0] * sides[1] > 0.2 * (sum(areas) - sides[0] * sides[1])

    kept = []
    for b in sorted(boxes, key=lambda b: (-b[6], b[1])):
        if not any(k[0] == b[0] and overlap(k, b) for k in kept):
            kept.append(b)
    faces, persons, expected = [], {}, {}
    for i in range(300):
        angle, owner, ok = r.uniform(0, 6.28), r.choice([1, 1, 1, 2]), r.random() < 0.8
        v, own = [math.cos(angle), math.sin(angle)], persons.setdefault(owner, [])
        faces.append((owner, i, v, "ok" if ok else "marginal"))
        sims = [sum(a * b for a, b in zip(c, v)) for c, _ in own]
        if sims and max(sims) >= 0.9:
            at = expected[i] = sims.index(max(sims))
            c, n = own[at]
            mean = [(a * n + b) / (n + 1) for a, b in zip(c, v)]
            own[at] = ([a / math.hypot(*mean) for a in mean] if ok else c, n + 1)
        else:
            expected[i] = len(own) if ok else None
            if ok:
                own.append((v, 1))
    with arrow_batches(spark, 7):
        got = clustering.non_maximum_suppression(spark.createDataFrame(boxes, "image string, id long, x1 double, y1 double, x2 double, y2 double, score double"), 0.2)
        assert sorted(x["id"] for x in got.collect()) == sorted(k[1] for k in kept)
        df = spark.createDataFrame(faces, "owner long, id long, embedding array<double>, verdict string").repartition(5)
        assert {x["id"]: x["person"] for x in clustering.register_faces(df, 0.9).collect()} == expected


def test_faces(spark):
    rows = [(1, 1, [1.0, 0.0], "ok"), (1, 2, [0.9, 0.1], "marginal"), (1, 3, [0.0, 1.0], "marginal"), (1, 4, [0.0, 1.0], "ok"), (2, 5, [1.0, 0.0], "ok")]
    faces = spark.createDataFrame(rows, "owner long, id long, embedding array<double>, verdict string")
    assert {r["id"]: r["person"] for r in clustering.register_faces(faces).collect()} == {1: 0, 2: 0, 3: None, 4: 1, 5: 0}


def test_points_in_regions(spark):
    def ring(points):
        return [(float(x), float(y)) for x, y in points]

    hole = [[ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (2, 1), (2, 2), (1, 2)])]]
    regions = spark.createDataFrame([(1, [0.0, 0.0, 4.0, 4.0], hole)], "id int, bbox array<double>, polygons array<array<array<struct<lon:double,lat:double>>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 9.0, 9.0)], "id int, lon double, lat double")
    assert {r["id"]: r["region_id"] for r in spatial.locate(points, regions).collect()} == {1: 1, 2: None, 3: None}


def test_points_on_a_slanted_edge(spark):
    """Points of the line itself lie where the crossing, reckoned from the vertex before the edge and with the product first, puts them."""
    ring = [(6.0, 6.0), (9.5, 6.0), (6.0, 9.5)]
    regions = spark.createDataFrame([(1, [6.0, 6.0, 9.5, 9.5], [[ring]])], REGION)
    places = [(k, 15.5 - k / 100, k / 100) for k in range(601, 950)]
    expected = {k for k, lon, lat in places if lon < (6.0 - 9.5) * (lat - 6.0) / (9.5 - 6.0) + 9.5}
    got = spatial.locate(spark.createDataFrame(places, "id int, lon double, lat double"), regions).where("region_id = 1")
    assert {r["id"] for r in got.collect()} == expected
    inside = spatial.in_region(F.col("lon"), F.col("lat"), F.col("polygons"))
    rays = spark.createDataFrame(places, "id int, lon double, lat double").crossJoin(regions.select("polygons")).where(inside)
    assert {r["id"] for r in rays.collect()} == expected


def test_given_order(spark):
    rows = spark.createDataFrame([("a", 1), ("c", 3)], "path string, v int")
    assert [(r["path"], r["v"]) for r in filters.in_given_order(["c", "b", "a"], rows, "path").collect()] == [("c", 3), ("b", None), ("a", 1)]


@pytest.mark.parametrize(
    "sql",
    [
        "", "select 1; select 2", "delete from t", "drop table t", "create table t (a int)", "set a=b", "cache table t", "refresh table t", "insert into t select 1", "show tables", "from t insert into s select a", "with a as (select 1) insert into t select * from a", "explain select 1",
        "select reflect('java.lang.System', 'exit', '0')", "select `java_method`('a', 'b')", "select * from parquet.`/tmp/x`", "select * from `parquet`.`/tmp/x`", "merge into t using s on t.a = s.a when matched then delete",
    ],
)
def test_guard_rejects(spark, sql):
    with pytest.raises(ValueError):
        sql_guard.query_of(spark, sql)


def test_guard_limits(spark):
    spark.range(50).createOrReplaceTempView("guard_rows")
    for sql in ("select id from guard_rows;", "select id, 'limit 3' as t from guard_rows where id in (select id from guard_rows limit 40)", "with a as (select * from guard_rows) select * from a -- delete"):
        assert sql_guard.run_guarded(spark, sql, 7).count() == 7
    assert sql_guard.run_guarded(spark, "select id from guard_rows limit 3", 7).count() == 3
    assert sql_guard.run_guarded(spark, "select 'parquet.`x`' as a, 'reflect(' as b", 7).count() == 1


REGION = "id long, bbox array<double>, polygons array<array<array<struct<lon:double,lat:double>>>>"


def ring_of(r, n, x, y, size, grid):
    """A star-shaped ring; on a grid many vertices share latitudes with points and tiles."""
    out = []
    for i in range(n):
        turn, far = 2 * math.pi * i / n, size * r.uniform(0.3, 1)
        p = (x + far * math.cos(turn), y + far * math.sin(turn))
        out.append(tuple(round(c / grid) * grid for c in p) if grid else p)
    return out


@pytest.mark.parametrize("grid, tile", [(0.0, 1.0), (0.5, 1.0), (0.25, 0.5), (1.0, 3.0)])
def test_locate_as_by_rays(spark, grid, tile):
    """Cells against the ray through all edges: holes, several polygons, rings that cross themselves, points on vertices and edges."""
    r = random.Random(int(grid * 100 + tile))
    regions = []
    for i in range(8):
        x, y = r.uniform(-6, 6), r.uniform(-6, 6)
        polygons = [[ring_of(r, r.choice([3, 7, 40]), x, y, 4, grid), ring_of(r, 5, x, y, 1, grid)], [ring_of(r, 6, x + 3, y, 2, grid)]]
        if i == 3:
            polygons.append([r.sample(polygons[0][0], len(polygons[0][0]))])
        flat = [p for poly in polygons for ring in poly for p in ring]
        box = [min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat)]
        regions.append((i, box, polygons))
    regions.append((99, [0.0, 0.0, 1.0, 1.0], [[[]]]))
    near = [p for _, _, polygons in regions for poly in polygons for ring in poly for p in ring][:60]
    points = [(round(r.uniform(-12, 12) * 4) / 4, round(r.uniform(-12, 12) * 4) / 4) if grid else (r.uniform(-12, 12), r.uniform(-12, 12)) for _ in range(500)] + near + near[:3]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(-1, None, 1.0)], "id long, lon double, lat double")
    rows = spark.createDataFrame(regions, REGION)
    b = F.col("bbox")
    boxed = F.col("lon").between(F.get(b, F.lit(0)), F.get(b, F.lit(2))) & F.col("lat").between(F.get(b, F.lit(1)), F.get(b, F.lit(3)))
    want = df.join(rows.withColumnRenamed("id", "region"), boxed & spatial.in_region(F.col("lon"), F.col("lat"), F.col("polygons")), "left").groupBy("id").agg(F.min("region").alias("region_id"))
    got = spatial.locate(df, rows, tile).select("id", "region_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cells_do_not_copy_polygons(spark):
    """A ring of 20 000 vertices over many tiles: each edge is held by few tiles, tiles of the inside by no edge."""
    ring = [(10 * math.cos(2 * math.pi * i / 20_000), 10 * math.sin(2 * math.pi * i / 20_000)) for i in range(20_000)]
    cells = spatial.region_cells(spark.createDataFrame([(1, [-10.0, -10.0, 10.0, 10.0], [[ring]])], REGION), 1.0)
    held = cells.agg(F.count("*").alias("cells"), F.sum(F.size("edges")).alias("edges"), F.count_if(F.size("edges") == 0).alias("inside"), F.max(F.when(F.size("edges") == 0, F.size("toggles"))).alias("toggles"), F.sum(F.size("toggles")).alias("all")).first()
    assert held["edges"] < 1.05 * 20_000 and held["inside"] > 200 and held["toggles"] == 1 and held["all"] < 2 * held["cells"]


def test_element_means(spark, monkeypatch):
    """Vectors of several lengths, nulls in them, null vectors and labels, in batches of few rows."""
    from tessera.operators.means import element_means

    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([None, [], [r.random(), None, r.random()], [r.random()], [r.random() for _ in range(5)]])) for _ in range(200)] + [("c", [None])]
    want = {}
    for label, v in rows:
        for i, x in enumerate(v or []):
            want.setdefault((label, i), []).append(x)
    mean = {k: (None if not [x for x in xs if x is not None] else round(sum(x for x in xs if x is not None) / len([x for x in xs if x is not None]), 9), len(xs)) for k, xs in want.items()}
    with arrow_batches(spark, 7):
        got = element_means(spark.createDataFrame(rows, "label string, embedding array<float>").withColumn("embedding", F.col("embedding").cast("array<double>")), "label").collect()
    assert {k for k in mean} == {(x["label"], x["pos"]) for x in got}
    for x in got:
        m, n = mean[x["label"], x["pos"]]
        assert x["rows"] == n and (x["m"] is None if m is None else abs(x["m"] - m) < 1e-6)


def test_matched_ranks_without_a_pass_over_all_levels(spark):
    """A row finds its level by halving, not by a walk through up to 256 levels; same levels as by sorted lists."""
    from tessera.operators import transfer

    r = random.Random(5)
    own, wanted = [(i, r.randrange(40)) for i in range(300)], sorted(r.randrange(60) for _ in range(211))
    source, reference = spark.createDataFrame(own, "id long, v int"), spark.createDataFrame([(x,) for x in wanted], "v int")
    out = transfer.matched_ranks(source, reference, "id", "v", block=64)
    ranked = sorted(own, key=lambda x: (x[1], x[0]))
    assert {x["id"]: x["matched"] for x in out.collect()} == {i: wanted[min(210, math.floor(k / 299 * 210))] for k, (i, _) in enumerate(ranked)}
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
