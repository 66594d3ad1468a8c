"""Results that are computed again only when the signature of their inputs changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.versions import Versions


def signature(tables: dict[str, tuple[DataFrame, str]], *also: str) -> str:
    """Rows and greatest value of a column of each table, and other things the result depends on, as one text.

    One aggregate of one column a table, so it costs a scan of that column.
    """
    parts = []
    for name, (rows, column) in sorted(tables.items()):
        n, last = rows.agg(F.count("*"), F.max(column).cast("string")).first()
        parts.append(f"{name}:{n}:{last or 0}")
    return "|".join([*parts, *also])


def exact_signature(rows: DataFrame, columns: list[str | Column]) -> str:
    """Rows and the sum of the hashes of the given columns: any changed value changes it, the order does not."""
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


class Kept:
    """One result in shared storage, with the signature it was made for.

    A new result is written beside the old one and published by a last small write, so a reader sees the old one
    or the new one, and a job that dies leaves the old one in place.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.published = Versions(spark, f"{self.path}/published")

    def _now(self) -> tuple[str, str] | None:
        rows = self.published.read()
        return None if rows is None else tuple(rows.select("signature", "at").first())

    def get(self, made_for: str, build: Callable[[], DataFrame], force: bool = False, old_on_error: bool = False) -> DataFrame:
        """The result for the signature ``made_for``: as stored, or built and stored if there is none or ``force`` is set.

        With ``old_on_error`` an old result stands in where the build fails; without one the error is raised.
        """
        now = self._now()
        if now and now[0] == made_for and not force:
            return self.spark.read.parquet(now[1])
        at = f"{self.path}/{uuid.uuid4().hex}"
        try:
            build().write.parquet(at)
        except Exception:
            if now and old_on_error:
                return self.spark.read.parquet(now[1])
            raise
        self.published.publish(self.spark.createDataFrame([(made_for, at)], "signature string, at string").coalesce(1))
        return self.spark.read.parquet(at)
