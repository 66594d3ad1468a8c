"""A table that several scans fill at their own pace, as a log of changes that may come late, twice or again from the start.

A change is a row with the key, a version, flags that say which groups of fields its scan owns, and the fields; or a deletion.
In order of versions, the fields of an owned group are taken over, nulls included; a field of another group is taken over
if it is not null; a deletion takes away all that is not newer. The outcome needs no order: of a field it takes the latest
owned value and the latest value that is not null, each with its version, and of these the later one. Such pairs are maxima,
and the maximum of maxima is again one, so changes are pre-aggregated as they arrive, appended, and merged on reading.
Merging is idempotent: a batch done twice, or a whole stream read again after its checkpoint was lost, changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.versions import Versions


class ScanTable:
    """The table at ``path``; ``groups`` maps the flag of a group to its fields. Changes need key, version, deleted, flags and fields."""

    def __init__(self, spark: SparkSession, path: str, key: str, groups: dict[str, list[str]]) -> None:
        self.spark, self.path, self.key, self.groups = spark, path.rstrip("/"), key, groups
        self.fields = [f for fields in groups.values() for f in fields]
        self.base = Versions(spark, f"{self.path}/base")

    def state_of(self, changes: DataFrame) -> DataFrame:
        """One row a key: the last deletion, the last version, and of each field the latest owned value and the latest value that is one.

        Equal versions are told apart by value, so repeated rows and any order give the same.
        """
        alive = ~F.coalesce(F.col("deleted"), F.lit(False))

        def latest(name: str, when: Column) -> Column:
            return F.max(F.when(when, F.struct(F.col("version").alias("at"), F.col(name).alias("value"))))

        columns = [F.max(F.when(~alive, F.col("version"))).alias("gone"), F.max(F.when(alive, F.col("version"))).alias("seen")]
        for flag, fields in self.groups.items():
            owned = F.coalesce(F.col(flag), F.lit(False))
            for f in fields:
                columns += [latest(f, alive & owned).alias(f"own_{f}"), latest(f, alive & ~owned & F.col(f).isNotNull()).alias(f"any_{f}")]
        return changes.where(F.col(self.key).isNotNull() & F.col("version").isNotNull()).groupBy(self.key).agg(*columns)

    def _merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(self.key).agg(*(F.max(c).alias(c) for c in states.columns if c != self.key))

    def _changes(self) -> list:
        """The folders of changes that are not in the base, written or being written."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/changes/*/*")
        return [f.getPath() for f in (folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder) or [])]

    def _states(self) -> DataFrame | None:
        parts = [p for p in (self.base.read(), self.spark.read.parquet(f"{self.path}/changes/*/*") if self._changes() else None) if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def append(self, changes: DataFrame, run: str | None = None, number: int = 0) -> None:
        """Take in a batch of changes; ``run`` and ``number`` name its folder."""
        self.state_of(changes).write.mode("overwrite").parquet(f"{self.path}/changes/{run or uuid.uuid4().hex}/{number}")

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in a stream of changes, all that is there now. Each start has a run of its own, so that no batch writes over one of an earlier checkpoint."""
        run = uuid.uuid4().hex
        return changes.writeStream.foreachBatch(lambda batch, number: self.append(batch, run, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def rows(self) -> DataFrame:
        """(key, version, fields): the table as it stands."""
        states = self._states()
        if states is None:
            raise ValueError(f"nothing was written to {self.path}")
        after = lambda c: F.when(F.col("gone").isNull() | (F.col(f"{c}.at") > F.col("gone")), F.col(c))
        out = []
        for f in self.fields:
            own, other = after(f"own_{f}"), after(f"any_{f}")
            out.append(F.when(own.isNull() | (other["at"] > own["at"]), other["value"]).otherwise(own["value"]).alias(f))
        alive = F.col("seen").isNotNull() & (F.col("gone").isNull() | (F.col("seen") > F.col("gone")))
        return self._merged(states).where(alive).select(self.key, F.col("seen").alias("version"), *out)

    def compact(self, forget_before: int | None = None) -> None:
        """Merge all changes into a new base, then delete them; deletions below version ``forget_before`` that nothing outlived are forgotten.

        If it dies in between, changes are merged once more, which changes nothing.
        """
        states = self._states()
        if states is None:
            return
        merged = self._merged(states)
        if forget_before is not None:
            merged = merged.where(F.col("gone").isNull() | (F.col("gone") >= forget_before) | (F.col("seen") > F.col("gone")))
        told = self._changes()
        number = self.base.publish(merged)
        for path in told:
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.base.drop_before(number)
