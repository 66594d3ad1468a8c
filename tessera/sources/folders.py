"""Folders and growing log files as data sources: tasks list and read, the driver holds no list of files or lines.

Both read folders that every executor sees under the same path, such as a mounted share. For stores that only Spark
reads there is ``scan_files`` in :mod:`tessera.sources.media`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.functions.paths import media_kind

#: Bytes of one file that a task reads, and of one that the first start of a tail goes back.
PIECE, BACK = 8 << 20, 1 << 62


def local_path(path: str) -> str:
    """A path without the scheme of local files."""
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _shown(folder: str) -> list[os.DirEntry]:
    """The entries of a folder by name, without hidden ones; none of a folder that cannot be read."""
    try:
        with os.scandir(folder) as entries:
            return sorted((e for e in entries if not e.name.startswith(".")), key=lambda e: e.name)
    except OSError:
        return []


class Below(InputPartition):
    """A folder, with all below it or its own files only."""

    def __init__(self, folder: str, deep: bool) -> None:
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, levels: int) -> None:
        self.root, self.levels = root, levels

    def partitions(self) -> list[InputPartition]:
        """The driver lists the folders of the first levels only; each folder of the last one is a task with all below it."""
        own, at = [], [self.root]
        for _ in range(self.levels):
            own += [Below(f, False) for f in at]
            at = [e.path for f in at for e in _shown(f) if e.is_dir(follow_symlinks=False)]
        return own + [Below(f, True) for f in at]

    def read(self, partition: Below) -> Iterator[tuple]:
        left = [partition.folder]
        while left:
            deeper = []
            for e in _shown(left.pop()):
                try:
                    if e.is_dir(follow_symlinks=False):
                        deeper.append(e.path)
                    elif e.is_file():
                        s = e.stat()
                        yield e.path, s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc)
                except OSError:  # it went meanwhile
                    continue
            if partition.deep:
                left += reversed(deeper)


class Tree(DataSource):
    """``path``, ``size`` and ``modified`` of the files below the option ``path``, links to folders and hidden entries left out; no file is opened."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, modified timestamp"

    def reader(self, schema) -> TreeReader:
        return TreeReader(local_path(self.options["path"]), int(self.options.get("levels", 1)))


def tree(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """(path, dir, name, kind, size, modified) of all files below ``root``; the folders ``levels`` below it are the tasks."""
    spark.dataSource.register(Tree)
    files = spark.read.format("tree").option("levels", levels).load(root)
    name = F.substring_index("path", "/", -1)
    folder = F.expr("left(path, char_length(path) - char_length(substring_index(path, '/', -1)) - 1)")
    return files.select("path", folder.alias("dir"), name.alias("name"), media_kind(F.col("path")).alias("kind"), "size", "modified")


class Stretch(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``stop``; ``end`` is where complete lines end."""

    def __init__(self, path: str, start: int, stop: int, end: int) -> None:
        super().__init__((path, start, stop, end))
        self.path, self.start, self.stop, self.end = path, start, stop, end


class TailReader(DataSourceStreamReader):
    """Offsets are bytes by inode, so a file that was renamed goes on where it was, and a new one of its name starts at 0."""

    def __init__(self, folder: str, suffix: str, piece: int, back: int) -> None:
        self.folder, self.suffix, self.piece, self.back = folder, suffix, piece, back

    def _files(self) -> dict[str, tuple[str, int]]:
        """Path and size by inode."""
        out = {}
        for e in _shown(self.folder):
            try:
                if e.is_file() and self.suffix in e.name:
                    s = e.stat()
                    out[str(s.st_ino)] = (e.path, s.st_size)
            except OSError:
                continue
        return out

    @staticmethod
    def _complete(path: str, size: int) -> int:
        """The place behind the last line end before ``size``, found from the end backwards."""
        try:
            with open(path, "rb") as f:
                while size > 0:
                    low = max(0, size - (1 << 16))
                    f.seek(low)
                    at = f.read(size - low).rfind(b"\n")
                    if at >= 0:
                        return low + at + 1
                    size = low
        except OSError:
            pass
        return 0

    def initialOffset(self) -> dict:
        return {i: max(0, size - self.back) for i, (_, size) in sorted(self._files().items())}

    def latestOffset(self) -> dict:
        return {i: self._complete(path, size) for i, (path, size) in sorted(self._files().items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files, out = self._files(), []
        for i, stop in end.items():
            begin = start.get(i, 0)
            if begin > stop:  # emptied and begun again
                begin = 0
            if i in files:
                out += [Stretch(files[i][0], at, min(at + self.piece, stop), stop) for at in range(begin, stop, self.piece)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        try:
            f = open(partition.path, "rb")
        except OSError:
            return
        with f:
            at = partition.start
            if at > 0:  # a line that began before belongs to whoever holds its beginning
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.stop:
                line = f.readline(partition.end - at)
                if not line:
                    return
                text = line.decode("utf-8", "replace").rstrip("\n").removesuffix("\r")
                if text.strip():
                    yield name, at, text
                at += len(line)


class LogTail(DataSource):
    """``file``, ``at`` and ``line`` of the log files of the option ``path`` as they grow; a last line without its end waits for it."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> TailReader:
        o = self.options
        return TailReader(local_path(o["path"]), o.get("suffix", ""), int(o.get("piece", PIECE)), int(o.get("back", BACK)))


def tailed(spark: SparkSession, folder: str, suffix: str = "", piece: int = PIECE, back: int = BACK) -> DataFrame:
    """Stream (file, at, line) of what is appended to the files of ``folder`` whose names hold ``suffix``.

    A task reads ``piece`` bytes of a file; the first start goes back ``back`` bytes of each file, to a whole line.
    """
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("suffix", suffix).option("piece", piece).option("back", back).load(folder)
