"""Folders listed in tasks, and log files followed by bytes."""

import os

from tessera.sources.folders import TailReader, tailed, tree


def test_tree(spark, tmp_path):
    for name in ("a/x.jpg", "a/b/y.MP4", "a/b/c/z.txt", "top.png", ".hidden/q.jpg", "a/.q.jpg", "e/ü 1.gif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * len(name))
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "file link.jpg").symlink_to(tmp_path / "a/x.jpg")
    (tmp_path / "none").mkdir()
    want = {"a/x.jpg": "image", "a/b/y.MP4": "video", "a/b/c/z.txt": None, "top.png": "image", "e/ü 1.gif": "animated", "file link.jpg": "image"}
    for levels in (0, 1, 2, 9):
        rows = tree(spark, f"file://{tmp_path}", levels).collect()
        assert {os.path.relpath(r["path"], tmp_path): r["kind"] for r in rows} == want and len(rows) == len(want)
    r = next(r for r in rows if r["name"] == "y.MP4")
    assert (r["dir"], r["size"]) == (str(tmp_path / "a/b"), 9)
    assert tree(spark, str(tmp_path / "absent")).count() == 0


def followed(spark, folder, tmp_path, piece):
    """What one run of the stream brings, from its checkpoint."""
    out = str(tmp_path / f"out{piece}")
    tailed(spark, folder, ".log", piece=piece).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"offsets{piece}")).trigger(availableNow=True).start(out).awaitTermination()
    return sorted((r["file"], r["at"], r["line"]) for r in spark.read.parquet(out).collect())


def test_tail(spark, tmp_path):
    """Half lines wait, a renamed file goes on, a new file of its name and an emptied one start anew; pieces of any size give the same."""
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "app.log").write_bytes("first\n\n  \nzweite ü\r\nhalf".encode())
    (logs / "other.txt").write_text("no\n")
    want = [("app.log", 0, "first"), ("app.log", 10, "zweite ü")]
    for piece in (4, 1 << 20):
        assert followed(spark, str(logs), tmp_path, piece) == want
    with open(logs / "app.log", "ab") as f:
        f.write(b" and whole\n\xff broken\nlast")
    want += [("app.log", 21, "half and whole"), ("app.log", 36, "� broken")]
    for piece in (4, 1 << 20):
        assert followed(spark, str(logs), tmp_path, piece) == sorted(want)
    with open(logs / "app.log", "ab") as f:
        f.write(b" one\n")
    os.rename(logs / "app.log", logs / "app.log.1")
    (logs / "app.log").write_text("new file\n")
    want += [("app.log.1", 45, "last one"), ("app.log", 0, "new file")]
    for piece in (4, 1 << 20):
        assert followed(spark, str(logs), tmp_path, piece) == sorted(want)
    (logs / "app.log").write_text("x\n")
    want += [("app.log", 0, "x")]
    for piece in (4, 1 << 20):
        assert followed(spark, str(logs), tmp_path, piece) == sorted(want)


def test_every_line_once_for_any_piece(tmp_path):
    lines = ["", "a", "bb" * 40, "", "c\r", "ü" * 9, "d"]
    path = tmp_path / "x.log"
    path.write_bytes("\n".join(lines).encode() + b"\n")
    whole = None
    for piece in (1, 2, 3, 7, 50, 1000):
        reader = TailReader(str(tmp_path), ".log", piece, 1 << 62)
        got = [t for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for t in reader.read(p)]
        whole = whole or got
        assert got == whole and [t[2] for t in got] == [x.removesuffix("\r") for x in lines if x]
    back = TailReader(str(tmp_path), ".log", 1000, 5)
    assert [t[2] for p in back.partitions(back.initialOffset(), back.latestOffset()) for t in back.read(p)] == ["d"]
