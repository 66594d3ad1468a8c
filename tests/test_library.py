"""Albums, persons and scan rules by hand-made rows."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import scans
from tessera.operators import albums, people


def test_states_and_problems(spark):
    assert albums.checked_state("hidden") == "hidden"
    with pytest.raises(ValueError):
        albums.checked_state("gone")
    rows = spark.createDataFrame([("a", "p", None), (" ", "p", None), ("n" * 101, "p", None), ("a", None, None), ("a", "p", "d" * 501), (None, None, None)], "n string, p string, d string")
    assert [r[0] for r in rows.select(albums.album_problem(F.col("n"), F.col("p"), F.col("d"))).collect()] == [None, "name", "name length", "path", "description length", "name"]
    assert [r[0] for r in spark.createDataFrame([("archived",), ("x",), (None,)], "k string").select(albums.is_virtual(F.col("k"))).collect()] == [True, False, False]


def test_merge_and_folders(spark):
    photos = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12)], "id long, album_id long")
    merges = spark.createDataFrame([(10, 12), (12, 12), (13, 12)], "source_id long, target_id long")
    moved, noted = albums.merged_albums(photos, merges, True, "now")
    assert sorted(map(tuple, moved.collect())) == [(1, 12), (2, 12), (3, 11), (4, 12)]
    assert sorted(map(tuple, noted.collect())) == [(12, 10, 2, "now"), (12, 13, 0, "now")]
    assert sorted(map(tuple, albums.merged_albums(photos, merges, False, "now")[0].collect())) == sorted(map(tuple, photos.collect()))
    folders = spark.createDataFrame([(1, None, 1, 0), (2, 1, 2, 0), (3, 2, 3, 4)], "id long, parent_id long, level int, sort_order long")
    asked = spark.createDataFrame([("a", None), ("b", 1), ("c", 1), ("d", 3), ("e", 99), ("f", 2), (" ", 2), ("\u3000 g\n", 2), (None, 99)], "name string, parent_id long")
    got = {r["name"]: (r["level"], r["sort_order"], r["problem"]) for r in albums.created_folders(folders, asked).collect()}
    assert got == {"a": (1, 1, None), "b": (2, 1, None), "c": (2, 2, None), "d": (None, None, "level"), "e": (None, None, "parent"), "f": (3, 5, None), "g": (3, 6, None), "": (None, None, "name")}


def test_rekeyed_and_relabelled(spark):
    rows = spark.createDataFrame([("old1", 1), ("new1", 9), ("own", 2)], "key string, id long")
    assert sorted(map(tuple, albums.rekeyed(rows, "key", F.concat(F.lit("old"), "id"), F.lit("new1")).collect())) == [("new1", 9), ("own", 2)]
    v = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "c", 7)], "k long, model string, x long")
    assert sorted(map(tuple, albums.relabelled(v, ["k"], "model", ["a"], "b").collect())) == [(1, "b", 5), (2, "c", 7)]
    assert albums.relabelled(v, ["k"], "model", ["a", "b"], "b") is v
    clash = spark.createDataFrame([(1, "c", 3), (1, "a", 5), (1, "n", 9)], "k long, model string, x long")
    assert [tuple(r) for r in albums.relabelled(clash, ["k"], "model", ["c", "a"], "n").collect()] == [(1, "n", 5)]
    assert [tuple(r) for r in albums.relabelled(clash, ["k"], "model", ["a", "c"], "n").collect()] == [(1, "n", 3)]


def test_first_item_and_any_case(spark):
    items = [("g", "/b/2", "/b", 1, "/gone", 0), ("g", "/a/1", "/a", 1, "/gone", 1), ("g", "/A/1", "/A", 1, "/gone", 2), ("h", "/a/1", "/a", 1, "/a/1", 0)]
    got = albums.sanitised_groups(spark.createDataFrame(items, "group_id string, path string, dir string, size long, keep_path string, place long")).collect()
    assert [tuple(r) for r in got] == [("g", "/b/2", 2, 1, 1, 1)]
    faces = spark.createDataFrame([("P1", "/Lib/A/x.jpg"), ("P1", "\\lib\\a\\y.jpg"), ("P2", "/lib/a/x.jpg"), ("P1", "/lib/ab/x.jpg"), ("P1", "/lib/a")], "person_id string, path string")
    roots, persons = spark.createDataFrame([(1, "/lib/a/")], "id long, root string"), spark.createDataFrame([("P1", "Ann")], "person_id string, name string")
    assert [tuple(r) for r in people.persons_below(faces, persons, roots).collect()] == [(1, "P1", "Ann", 2)]


def test_face_verdicts(spark):
    def face(size, points):
        return ({"x1": 0.0, "y1": 0.0, "x2": size, "y2": size}, [{"x": x * size, "y": y * size} for x, y in points])

    good = [(0.3, 0.4), (0.7, 0.4), (0.5, 0.6), (0.35, 0.8), (0.65, 0.8)]
    turned = [(0.3, 0.4), (0.7, 0.4), (0.66, 0.6), (0.35, 0.8), (0.65, 0.8)]
    rows = [face(100.0, good), face(60.0, good), face(40.0, good), face(100.0, turned), face(100.0, [(0.5, 0.4)] * 5)]
    kind = "box struct<x1:double,y1:double,x2:double,y2:double>, points array<struct<x:double,y:double>>"
    got = spark.createDataFrame(rows, kind).select(people.face_verdict(F.col("box"), F.col("points"))).collect()
    assert [r[0] for r in got] == ["ok", "marginal", "reject", "marginal", "reject"]


def test_scan_rules(spark):
    rows = spark.createDataFrame([(5.0,), (50.0,), (500.0,), (math.inf,), (None,)], "ms double").select(scans.duration(F.col("ms")))
    assert [r[0] for r in rows.collect()] == ["5.00", "50.0", "500", "-", "-"]
    dates = spark.createDataFrame([('"2020:01:02 03:04:05"',), ("2020",), ("20x0:01:02",), (None,)], "t string").select(scans.iso_date(F.col("t")))
    assert [r[0] for r in dates.collect()] == ["2020-01-02", None, None, None]
    times = spark.createDataFrame([(1969, 12, 31, 23, 59, 58), (2000, 2, 29, 0, 0, 0), (2001, 2, 29, 0, 0, 0)], "y int, m int, d int, h int, n int, s int")
    seconds = times.select(scans.unix_seconds(*map(F.col, "ymdhns")).alias("s"))
    assert [r["s"] for r in seconds.collect()] == [-2, 951782400, None]
    assert tuple(seconds.select(scans.civil_time(F.col("s")).alias("c")).first()["c"]) == (1969, 12, 31, 23, 59, 58)
    blobs = spark.createDataFrame([(struct.pack("<2f", 1.5, -2.0) + b"x",), (b"",), (None,)], "b binary").select(scans.vector_of_bytes("b").alias("v"))
    assert [r["v"] for r in blobs.collect()] == [[1.5, -2.0], [], None]
    assert [bytes(r[0]) if r[0] is not None else None for r in blobs.select(scans.bytes_of_vector("v")).collect()] == [struct.pack("<2f", 1.5, -2.0), b"", None]
    vectors = [[float(i), -0.5] * (i % 4) if i % 5 else None for i in range(300)]
    there = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i long, v array<float>").repartition(3).select("i", scans.bytes_of_vector("v").alias("b"))
    assert {r["i"]: r["b"] and bytes(r["b"]) for r in there.collect()} == {i: None if v is None else struct.pack(f"<{len(v)}f", *v) for i, v in enumerate(vectors)}
    assert {r["i"]: r["v"] for r in there.select("i", scans.vector_of_bytes("b").alias("v")).collect()} == dict(enumerate(vectors))
