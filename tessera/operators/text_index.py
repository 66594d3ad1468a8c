"""An inverted index of words: built, kept up and searched as tables.

A segment holds the words of a batch of rows: postings dealt to ranges of (word, id), each range a partition folder, and a
dictionary with the first and last word of each range. A posting row has up to CHUNK ids of one word in order, as offsets
from the first, so a word that a third of all rows hold is many rows in several ranges, and small offsets compress well.
Rows that are removed or replaced are noted as tombstones, which hide what earlier segments say of them. Which segments
are live stands in a table that is published last, so a batch that died is as if it had never begun.

A search asks the dictionaries which ranges may hold its words and reads these partitions alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import arrow_batches
from tessera.sources.versions import Versions

#: Ids in one posting row, at most.
CHUNK = 1 << 14
POSTINGS = "word string, first bigint, offsets array<bigint>"
SEGMENTS = "segment string, place long"


def words_of(text: Column) -> Column:
    """The words of a text: runs of letters and digits, in lower case; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


class Asked(NamedTuple):
    """One alternative of a search: neighbouring words of which the last may be a beginning only."""

    words: tuple[str, ...]
    prefix: bool


def parsed(keyword: str) -> list[Asked] | None:
    """The alternatives of a keyword, or None if it is no index search: empty, or with signs that the search language has no use for.

    Words between single blanks are alternatives. A star at the end of a word asks for all words that begin with it; without
    any star the last word is meant so. A word with inner signs, such as an underscore, is a phrase.
    """
    parts = keyword.strip().split(" ")
    stars = "*" in keyword
    asked = []
    for i, part in enumerate(parts):
        prefix = part.endswith("*") if stars else i == len(parts) - 1
        bare = part[:-1] if part.endswith("*") else part
        if not re.fullmatch(r"[A-Za-z0-9_\x1a\x80-\U0010ffff]+", bare) or bare in ("AND", "OR", "NOT"):
            return None
        words = tuple(w for w in re.split(r"[\W_]+", bare.lower()) if w)
        if words:
            asked.append(Asked(words, prefix))
    return asked


def says(text: Column, asked: list[Asked]) -> Column:
    """Whether a text itself has one of the alternatives: the same answer without an index."""

    def found(words: Column, one: Asked) -> Column:
        def at(i: Column) -> Column:
            tests = [F.get(words, i + k) == w for k, w in enumerate(one.words[:-1])]
            last = F.get(words, i + len(one.words) - 1)
            tests.append(last.startswith(one.words[-1]) if one.prefix else last == one.words[-1])
            return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

        return F.exists(F.sequence(F.lit(0), F.size(words)), at)

    # the words are bound to a lambda variable, so that they are split once a text
    return F.exists(F.array(words_of(text)), lambda words: reduce(lambda a, b: a | b, (found(words, one) for one in asked), F.lit(False)))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A posting row for each run of one word in a batch; batches are sorted by (word, id), so a longer run is several rows. Rows that repeat count once."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        runs = pc.run_end_encode(batch.column("word"), run_end_type=pa.int64())
        starts = np.concatenate([[0], runs.run_ends.to_numpy()[:-1]])
        ids = batch.column("id").to_numpy()
        fresh = np.append(True, ids[1:] != ids[:-1])
        fresh[starts] = True
        fresh[0] = last != (runs.values[0].as_py(), int(ids[0]))
        last = (runs.values[-1].as_py(), int(ids[-1]))
        run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))[fresh]
        ids = ids[fresh]
        if not len(ids):
            continue
        held, starts = np.unique(run_of, return_index=True)
        bounds = np.append(starts, len(ids))
        offsets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids - np.repeat(ids[starts], np.diff(bounds))))
        yield pa.RecordBatch.from_arrays([runs.values.take(pa.array(held)), pa.array(ids[starts]), offsets], names=["word", "first", "offsets"])


class TextIndex:
    """The index at ``path`` of rows with a long ``key`` and a text column."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Versions(spark, f"{self.path}/manifest")

    def segments(self) -> list[tuple[str, int]]:
        """The live segments by place; a list as short as the batches since the last merge."""
        live = self.manifest.read()
        return [] if live is None else sorted(((r["segment"], r["place"]) for r in live.collect()), key=lambda s: s[1])

    def _publish(self, segments: list[tuple[str, int]]) -> None:
        self.manifest.publish(self.spark.createDataFrame(segments, SEGMENTS).coalesce(1))

    def _write(self, postings: DataFrame, gone: DataFrame | None) -> str:
        """A segment of rows (word, id), which may repeat, and of ids that earlier segments no longer tell of."""
        name = uuid.uuid4().hex
        at, ranges = f"{self.path}/{name}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = postings.repartitionByRange(ranges, "word", "id").sortWithinPartitions("word", "id")
        with arrow_batches(self.spark, CHUNK):
            dealt.mapInArrow(_postings, POSTINGS).withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(f"{at}/postings")
        self._postings_of(name).groupBy("range").agg(F.min("word").alias("low"), F.max("word").alias("high"), F.count("*").alias("rows")).write.parquet(f"{at}/dictionary")
        (gone if gone is not None else self.spark.createDataFrame([], "id long")).select(F.col("id").cast("long")).distinct().write.parquet(f"{at}/gone")
        return name

    def _postings_of(self, segment: str) -> DataFrame:
        return self.spark.read.schema(f"{POSTINGS}, range int").parquet(f"{self.path}/{segment}/postings")

    def add(self, rows: DataFrame, key: str, text: str) -> None:
        """Rows that are new, or that replace what is known under their keys. Rows without a key are left out."""
        keyed = rows.where(F.col(key).isNotNull())
        known = self.segments()
        postings = keyed.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("word"), F.col(key).cast("long").alias("id"))
        self._publish([*known, (self._write(postings, keyed.select(F.col(key).alias("id")) if known else None), known[-1][1] + 1 if known else 0)])

    def remove(self, keys: DataFrame, key: str) -> None:
        known = self.segments()
        nothing = self.spark.createDataFrame([], "word string, id long")
        self._publish([*known, (self._write(nothing, keys.where(F.col(key).isNotNull()).select(F.col(key).alias("id"))), known[-1][1] + 1 if known else 0)])

    def merge(self) -> None:
        """All segments as one, without what is gone."""
        if known := self.segments():
            self._publish([(self._write(self._live(known), None), known[-1][1] + 1)])

    def ranges(self, segment: str, asked: list[Asked]) -> list[int]:
        """The ranges of a segment that may hold a word of ``asked``."""
        dictionary = self.spark.read.schema("range int, low string, high string, rows long").parquet(f"{self.path}/{segment}/dictionary")
        low, high = F.col("low"), F.col("high")
        tests = [(high >= w) & (low.startswith(w) | (low <= w) if prefix else low <= w) for w, prefix in _single(asked)]
        touched = dictionary.where(reduce(lambda a, b: a | b, tests, F.lit(False))).select("range")
        return sorted(r["range"] for r in touched.collect())

    def _live(self, segments: list[tuple[str, int]], asked: list[Asked] | None = None) -> DataFrame:
        """(word, id) that live segments tell, of all words or of those asked for."""
        out = self.spark.createDataFrame([], "word string, id long")
        later: DataFrame | None = None
        for segment, _ in reversed(segments):
            rows = self._postings_of(segment)
            if asked is not None:
                word = F.col("word")
                tests = [word.startswith(w) if prefix else word == w for w, prefix in _single(asked)]
                rows = rows.where(F.col("range").isin(self.ranges(segment, asked))).where(reduce(lambda a, b: a | b, tests, F.lit(False)))
            told = rows.select("word", F.explode(F.transform("offsets", lambda o: F.col("first") + o)).alias("id"))
            out = out.union(told if later is None else told.join(later, "id", "left_anti").select("word", "id"))
            gone = self.spark.read.schema("id long").parquet(f"{self.path}/{segment}/gone")
            later = gone if later is None else later.union(gone)
        return out

    def found(self, asked: list[Asked]) -> DataFrame:
        """(id) of the rows that hold all words of one of the alternatives, in any order: the phrases among them are still to be checked."""
        if not asked:
            return self.spark.createDataFrame([], "id long")
        told = self._live(self.segments(), asked)
        if all(len(one.words) == 1 for one in asked):
            return told.select("id").distinct()
        word = F.col("word")
        flags = [F.bool_or(word.startswith(w) if prefix else word == w).alias(f"w{i}") for i, (w, prefix) in enumerate(_single(asked))]
        tests, at = [], 0
        for one in asked:
            tests.append(reduce(lambda a, b: a & b, (F.col(f"w{at + k}") for k in range(len(one.words)))))
            at += len(one.words)
        return told.groupBy("id").agg(*flags).where(reduce(lambda a, b: a | b, tests)).select("id")


def _single(asked: list[Asked]) -> list[tuple[str, bool]]:
    return [(w, one.prefix and k == len(one.words) - 1) for one in asked for k, w in enumerate(one.words)]


def like_any_case(text: Column, keyword: str) -> Column:
    """Whether a text is LIKE the trimmed keyword between percent signs: A-Z match in either case, % and _ in the keyword are wild."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = keyword.strip().translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.translate(text, upper, lower).like(f"%{pattern}%")


def search_content(rows: DataFrame, index: TextIndex, keyword: str, key: str, text: str, newest: str | None = None) -> DataFrame:
    """``rows`` that answer a keyword: by the index, in order of the key, or else, if it is no index search, by LIKE, newest first."""
    asked = parsed(keyword)
    if asked is None:
        return rows.where(like_any_case(F.col(text), keyword)).orderBy(*([F.desc(newest)] if newest else []), F.desc(key))
    met = rows.join(index.found(asked).withColumnRenamed("id", key), key, "left_semi")
    if any(len(one.words) > 1 for one in asked):
        met = met.where(says(F.col(text), asked))
    return met.orderBy(key)
