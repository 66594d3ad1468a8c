"""Storage that all executors and the driver see."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``.

    Where that setting is absent a local session (tests on one machine) gets a
    temporary folder, made once; a cluster, whose machines don't share one, an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    This cuts the lineage: a lost executor costs the rereading of finished
    files, never a recomputation, and what was written no longer changes.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes (one row at least) for the jobs run inside."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def dealt_anew(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` behind an exchange by other columns than those of the join that follows.

    A join on the key of an aggregate reuses the aggregate's partitions, which cannot be split. After
    this both sides get plain exchanges of their own, so AQE can split a partition that one key fills.
    """
    return df.repartition(*columns)


class Scratch:
    """Tables in shared storage that one computation needs only until its result is written.

    As a context manager it deletes them at the end, also after an error.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.clear()

    def path(self, name: str) -> str:
        self.paths.append(shared_path(self.spark, name))
        return self.paths[-1]

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stage_by(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` written with a folder for each value of ``column``, so that its rows can be read alone; large ones in several files."""
        path = self.path(name)
        df.hint("rebalance", column).write.partitionBy(column).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(df.columns)

    def clear(self) -> None:
        """Delete the tables; nothing may read them any more."""
        for path in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = []
