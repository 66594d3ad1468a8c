"""Folder scans and exports."""

from pyspark.sql import functions as F

from tessera.operators.export import bar_percents, organised, unique_names
from tessera.sources.media import distinct_files, folder_totals, log_lines, media_files, scan_files


def test_folder_scan(spark, tmp_path):
    for name, size in (("a/x.jpg", 3), ("a/y.MP4", 5), ("a/.hidden.jpg", 7), ("a/.git/z.jpg", 7), ("b/c/v.gif", 2), ("b/notes.txt", 1)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"0" * size)
    files = scan_files(spark, str(tmp_path))
    assert sorted(r["name"] for r in files.collect()) == ["notes.txt", "v.gif", "x.jpg", "y.MP4"]
    totals = {r["dir"].rsplit("/", 1)[1]: r for r in folder_totals(media_files(spark, str(tmp_path))).collect()}
    assert (totals["a"]["files"], totals["a"]["bytes"], totals["a"]["n_video"]) == (2, 8, 1) and totals["a"]["cover"].endswith("x.jpg")
    assert totals["c"]["n_animated"] == 1
    assert scan_files(spark, str(tmp_path), with_content=True).where("name = 'x.jpg'").first()["content"] == b"000"


def test_distinct_files(spark):
    rows = spark.createDataFrame([("i1", 2, "/b/x"), ("i1", 1, "/a/x"), ("i2", 3, "/c")], "ident string, album_id long, path string")
    assert sorted((r["ident"], r["album_id"], r["path"]) for r in distinct_files(rows, "ident").collect()) == [("i1", 1, "/a/x"), ("i2", 3, "/c")]


def test_log_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.txt").write_text("one\ntwo\n")
    query = log_lines(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("log_lines").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("log_lines").count() == 2


def test_names_and_folders(spark):
    files = spark.createDataFrame([("/a/x.jpg",), ("/b/x.jpg",), ("/c/x",), ("/d/y.jpg",)], "path string")
    taken = spark.createDataFrame([("y.jpg",)], "name string")
    assert {r["path"]: r["target"] for r in unique_names(files, taken).collect()} == {"/a/x.jpg": "x.jpg", "/b/x.jpg": "x_1.jpg", "/c/x": "x", "/d/y.jpg": "y_1.jpg"}
    rows = spark.createDataFrame([("2024-01-02", "a/b"), (None, None), ("", " ")], "shoot_time string, location string")
    assert [r["folder"] for r in organised(rows).collect()] == ["2024/a_b", "unknown-year/unknown-place", "unknown-year/unknown-place"]
    bars = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double").select(bar_percents(F.col("v"), F.lit(1.0), F.lit(3.0)).alias("b"))
    assert [r["b"] for r in bars.collect()] == [8.0, 100.0, 8.0]
