"""Tables kept in numbered versions, published whole or not at all."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Versions of a table below ``path``; the latest is the highest one that was written to its end.

    Spark's writer puts a mark into a folder once all tasks have ended. A version without it, of a job that died, is
    never read; the next one gets a higher number.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, whole: bool) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*" + ("/_SUCCESS" if whole else ""))) or []
        return sorted(int(m[1]) for f in found if (m := re.search(r"/v=(\d+)(/_SUCCESS)?$", str(f.getPath()))))

    def latest(self) -> int | None:
        return max(self._numbers(True), default=None)

    def read(self, number: int | None = None) -> DataFrame | None:
        number = self.latest() if number is None else number
        return None if number is None else self.spark.read.parquet(f"{self.path}/v={number}")

    def publish(self, df: DataFrame) -> int:
        """Write ``df``, which may read the present version, as the next one; its number."""
        number = max(self._numbers(False), default=-1) + 1
        df.write.parquet(f"{self.path}/v={number}")
        return number

    def drop_before(self, number: int) -> None:
        """Delete versions below ``number``; nothing may read them any more."""
        for n in self._numbers(False):
            if n < number:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={n}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
