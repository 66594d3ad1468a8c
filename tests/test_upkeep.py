"""Tables that are kept up: scans in any order, results by signature, moved paths, persons across runs, names for export."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import moves as moving
from tessera.operators.clustering import NOBODY, FaceRegistry, register_faces
from tessera.operators.export import unique_names
from tessera.sources.kept import Kept, exact_signature, signature
from tessera.sources.versions import Versions
from tessera.streaming.incremental import scan_incrementally
from tessera.streaming.scan_table import ScanTable

CHANGE = "path string, version long, deleted boolean, ai boolean, exif boolean, label string, score double, place string"
GROUPS = {"ai": ["label", "score"], "exif": ["place"]}


def folded(changes):
    """The changes one after the other, as a table in one process takes them."""
    rows = {}
    for path, version, deleted, ai, exif, label, score, place in sorted(set(changes), key=lambda c: c[1]):
        if deleted:
            rows.pop(path, None)
            continue
        now = rows.setdefault(path, {"label": None, "score": None, "place": None})
        for owned, names, values in ((ai, ("label", "score"), (label, score)), (exif, ("place",), (place,))):
            for name, value in zip(names, values, strict=True):
                now[name] = value if owned or value is not None else now[name]
        now["version"] = version
    return {path: (r["version"], r["label"], r["score"], r["place"]) for path, r in rows.items()}


def made_changes(seed, n=240):
    draw = random.Random(seed)
    versions = draw.sample(range(10 * n), n)
    return [(f"p{draw.randrange(25)}", v, draw.random() < 0.15, draw.random() < 0.5, draw.choice([True, False, None]), draw.choice(["a", "b", None]), draw.choice([1.0, 2.0, None]), draw.choice(["x", None])) for v in versions]


def stored(table):
    return {r["path"]: tuple(r)[1:] for r in table.rows().select("path", "version", "label", "score", "place").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_table_in_any_order(spark, tmp_path, seed):
    """Batches late, repeated and shuffled, merged in between, against the fold in order of versions."""
    changes = made_changes(seed)
    table, draw = ScanTable(spark, str(tmp_path), "path", GROUPS), random.Random(seed)
    late = draw.sample(changes, len(changes))
    batches = [late[i : i + 60] for i in range(0, len(late), 60)]
    for i, batch in enumerate([*batches, batches[0]]):
        table.append(spark.createDataFrame(batch + batch[:5], CHANGE))
        if i == 2:
            table.compact()
    assert stored(table) == folded(changes)
    table.compact(forget_before=10**9)
    assert stored(table) == folded(changes)
    assert table.base.read().where("gone is not null and (seen is null or seen <= gone)").count() == 0


def test_scan_stream_survives_a_lost_checkpoint(spark, tmp_path):
    changes, source = made_changes(3), str(tmp_path / "in")
    table = ScanTable(spark, str(tmp_path / "table"), "path", GROUPS)
    stream = lambda checkpoint: table.follow(spark.readStream.schema(CHANGE).parquet(source), str(tmp_path / checkpoint)).awaitTermination()
    for part, checkpoint in ((changes[:100], "a"), (changes[100:180], "a"), (changes[180:], "lost and begun again")):
        spark.createDataFrame(part, CHANGE).write.mode("append").parquet(source)
        stream(checkpoint)
    assert stored(table) == folded(changes)
    with pytest.raises(ValueError):
        ScanTable(spark, str(tmp_path / "none"), "path", GROUPS).rows()


def test_new_rows_after_a_lost_checkpoint(spark, tmp_path):
    """Rows of an earlier start stay, also when the source no longer has them."""
    schema, target = "id long, v string", str(tmp_path / "out")
    for i, ids in enumerate(([1, 2], [2, 3], [3])):
        spark.createDataFrame([(x, f"{i}") for x in ids], schema).write.parquet(str(tmp_path / f"in{i}"))
        scan_incrementally(spark.readStream.schema(schema).parquet(str(tmp_path / f"in{i}")), "id", target, str(tmp_path / f"offsets{i}")).awaitTermination()
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(target).collect()) == [(1, "0"), (2, "0"), (3, "1")]


def test_kept_results(spark, tmp_path):
    built = []
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")

    def build():
        built.append(1)
        return rows.groupBy().agg(F.count("*").alias("n"))

    kept = Kept(spark, str(tmp_path / "kept"))
    first = signature({"t": (rows, "id")}, "model:x")
    assert first == "t:2:2|model:x"
    assert signature({"t": (spark.range(9, 12), "id"), "none": (spark.range(0), "id")}) == "none:0:0|t:3:11"
    assert [kept.get(first, build).first()["n"] for _ in range(3)] == [2, 2, 2] and len(built) == 1
    assert kept.get(first, build, force=True).first()["n"] == 2 and len(built) == 2
    assert "Exchange" not in kept.get(first, build)._jdf.queryExecution().toString()
    broken = lambda: spark.range(1).select(F.raise_error(F.lit("no")))
    assert kept.get("other", broken, old_on_error=True).first()["n"] == 2
    with pytest.raises(Exception, match="no"):
        kept.get("other", broken)
    assert kept.get(first, broken).first()["n"] == 2
    with pytest.raises(Exception, match="no"):
        Kept(spark, str(tmp_path / "empty")).get("s", broken, old_on_error=True)
    changed = spark.createDataFrame([(2, "b"), (1, "c")], "id long, v string")
    assert exact_signature(rows, ["id", "v"]) == exact_signature(rows.orderBy(F.desc("id")), ["id", "v"]) != exact_signature(changed, ["id", "v"])


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    assert (v.latest(), v.read()) == (None, None)
    assert [v.publish(spark.range(n)) for n in (1, 2)] == [0, 1] and v.read().count() == 2
    (tmp_path / "v=2").mkdir()  # of a job that died
    assert v.latest() == 1 and v.publish(v.read().union(spark.range(1))) == 3 and v.read().count() == 3
    v.drop_before(3)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v=3"]


def one_by_one(rows, log):
    """(path, album) of each row after the moves, one after the other."""
    at = {i: (path, None, -1) for i, path in rows}
    for seq, old, new, album in sorted(log):
        at = {i: (new, album, seq) if now[0] == old and old != new else now for i, now in at.items()}
    return at


def test_moves(spark):
    """Chains, swaps over a third path, circles and clashes, against moves one by one."""
    draw = random.Random(8)
    paths = [f"/d{i % 3}/f{i}" for i in range(14)]
    logs = [
        [(1, "/a/x", "/b/y", 7), (2, "/b/y", "/c/z", 8), (3, "/a/x", "/d/w", 9)],
        [(1, paths[0], "/t", 1), (2, paths[1], paths[0], 2), (3, "/t", paths[1], 3), (4, paths[2], paths[2], 4)],
        [(i, *draw.choices(paths, k=2), i % 5) for i in range(60)],
        [(i, f"/chain/{i}", f"/chain/{i + 1}", i) for i in range(40)],
        [],
    ]
    rows = [(i, p) for i, p in enumerate([*paths, paths[0], "/a/x", "/b/y", "/chain/0", "/chain/17"])] + [(99, None)]
    for log in logs:
        moves = spark.createDataFrame([*log, (None, "/a/x", "/null", 1), (1000, None, "/null", 1)], "seq long, old_path string, new_path string, album_id long")
        df = spark.createDataFrame([(i, p, "old", -5) for i, p in rows], "id long, path string, dir string, album_id long")
        tables = {"photos": moving.Held(df, "path", "dir", "album_id"), "hits": moving.Held(df.select("id", "path")), "ratings": moving.Held(df.select("path", "id"), key=("path",))}
        out, want = moving.moved_everywhere(tables, moves), one_by_one(rows, log)
        assert {r["id"]: (r["path"], r["album_id"], r["dir"]) for r in out["photos"].collect()} == {i: (p, -5, "old") if seq < 0 else (p, album, p.rsplit("/", 1)[0]) for i, (p, album, seq) in want.items()}
        assert {r["id"]: r["path"] for r in out["hits"].collect()} == {i: w[0] for i, w in want.items()}
        last = {p: max((seq, i) for i, (q, _, seq) in want.items() if q == p)[1] for p, _, _ in want.values()}
        assert {r["path"]: r["id"] for r in out["ratings"].collect()} == last
    gone = moving.deleted_everywhere({"hits": moving.Held(df.select("id", "path"))}, spark.createDataFrame([("/a/x",), (None,)], "path string"))
    assert sorted(r["id"] for r in gone["hits"].collect()) == sorted(i for i, p in rows if p != "/a/x")


@pytest.fixture(scope="module")
def faces(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8))
    made = [(int(i % 3), i, [float(x) for x in centres[draw.integers(6)] + 0.35 * draw.normal(size=8)], "ok" if draw.random() < 0.8 else "marginal") for i in range(240)]
    return made, spark.createDataFrame(made, "owner long, id long, embedding array<double>, verdict string")


def test_registry_goes_on(spark, faces, tmp_path):
    """Four parts one after the other give what the whole sequence gives; owners without new faces keep their persons."""
    _, df = faces
    whole = {(r["owner"], r["id"]): (r["person"], round(r["sim"], 9)) for r in register_faces(df, 0.6).collect()}
    registry, got = FaceRegistry(spark, str(tmp_path), 0.6), {}
    for part in ("id < 60", "id between 60 and 99 and owner <> 1", "id between 60 and 99 and owner = 1", "id > 99"):
        got |= {(r["owner"], r["id"]): (r["person"], round(r["sim"], 9)) for r in registry.register(df.where(part)).collect()}
    assert got == whole
    persons = {(r["owner"], r["person"]): r["faces"] for r in registry.persons().collect()}
    assert persons == Counter((o, person) for (o, _), (person, _) in whole.items() if person is not None)


def test_overrides_come_first(spark, tmp_path):
    face = lambda i, x, verdict="ok": (1, i, x, verdict)
    schema = "owner long, id long, embedding array<double>, verdict string"
    registry = FaceRegistry(spark, str(tmp_path), 0.9)
    registry.register(spark.createDataFrame([face(1, [1.0, 0.0]), face(2, [0.0, 1.0])], schema))
    overrides = spark.createDataFrame([(1, 3, 1), (1, 4, NOBODY), (1, 5, 77)], "owner long, id long, person long")
    out = registry.register(spark.createDataFrame([face(3, [1.0, 0.0], "marginal"), face(4, [1.0, 0.0]), face(5, [1.0, 0.0]), (None, 6, [1.0, 0.0], "ok"), (1, 7, None, "ok"), face(8, [-1.0, -1.0], "marginal")], schema), overrides)
    assert {r["id"]: (r["person"], round(r["sim"], 6)) for r in out.collect() if r["id"] != 8} == {3: (1, 1.0), 4: (None, 0.0), 5: (0, 1.0)}
    assert {r["person"]: (r["faces"], [round(x, 6) for x in r["centroid"]]) for r in registry.persons().collect()} == {0: (2, [1.0, 0.0]), 1: (2, [0.0, 1.0])}


def names_in_turn(paths, taken):
    used, out = set(taken), []
    for path in paths:
        name = path.rsplit("/", 1)[1]
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        target, i = name, 1
        while target in used:
            target, i = f"{stem}_{i}{ext}", i + 1
        used.add(target)
        out.append(target)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_export_names_as_in_turn(spark, seed):
    """Names that are numbers of other names, at several depths, against one file after the other."""
    draw = random.Random(seed)
    names = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "a_1_2.jpg", "a_3.jpg", "a_10.jpg", "a_01.jpg", "b", "b_1", "b_2", ".rc", ".rc_1", "a_1_1_1.jpg", "c_1.x.y", "c.x.y", "c.x_1.y"]
    paths = sorted({f"/{draw.randrange(400):03d}/{draw.choice(names[: 3 + 5 * seed])}" for _ in range(150)})
    taken = draw.sample(names, seed)
    df = spark.createDataFrame([(p, "clash") for p in draw.sample(paths, len(paths))], "path string, extra string")
    got = {r["path"]: r["target"] for r in unique_names(df, spark.createDataFrame([(t,) for t in taken], "name string")).collect()}
    assert [got[p] for p in paths] == names_in_turn(paths, taken)
    assert len(set(got.values()) | set(taken)) == len(paths) + len(taken)


def test_export_query(spark, sf_dir):
    from tessera.plans.upkeep import export_names_clashing

    rows = sorted(map(tuple, export_names_clashing(spark, sf_dir).select("path", "target").collect()))
    assert [t for _, t in rows] == names_in_turn([p for p, _ in rows], ["IMG3.jpg", "IMG4_2.jpg"])


def test_next_moves_in_one_pass(spark, monkeypatch):
    """Of many moves at one path, the next one of each is found in one pass: no frame reaches to the end, which Spark reckons anew for each row."""
    plans, plain = [], moving.forest_roots
    monkeypatch.setattr(moving, "forest_roots", lambda parents, scratch: plans.append(parents._jdf.queryExecution().optimizedPlan().toString()) or plain(parents, scratch))
    log = spark.createDataFrame([(i, "ab"[i % 2], "ba"[i % 2], i) for i in range(101)], "seq long, old_path string, new_path string, album_id long")
    got = {r["old_path"]: (r["new_path"], r["seq"]) for r in moving.resolved_moves(log).collect()}
    assert got == {"a": ("b", 100), "b": ("b", 100)}
    assert plans and "unboundedfollowing" not in plans[0].lower()
