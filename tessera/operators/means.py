"""Element-wise means of vectors, summed up in Arrow batches before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, pos, s, n, rows) of a batch: of each label and place the sum of the numbers, their count, and the vectors that reach so far."""
    for batch in batches:
        held = batch.filter(batch.column("vector").is_valid())
        if not len(held):
            continue
        labels = held.column("label").dictionary_encode(null_encoding="encode")
        vectors = held.column("vector")
        lengths = vectors.value_lengths().to_numpy()
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        pos = np.arange(len(starts)) - starts
        values = vectors.flatten().cast(pa.float64())
        known = values.is_valid().to_numpy(zero_copy_only=False)
        width = int(lengths.max(initial=0))
        cells = np.repeat(labels.indices.to_numpy(), lengths) * width + pos
        size = len(labels.dictionary) * width
        sums = np.bincount(cells[known], values.fill_null(0.0).to_numpy()[known], size)
        n, rows = np.bincount(cells[known], minlength=size), np.bincount(cells, minlength=size)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [labels.dictionary.take(pa.array(at // width if width else at)), pa.array((at % width if width else at).astype(np.int32)), pa.array(sums[at]), pa.array(n[at]), pa.array(rows[at])],
            names=["label", "pos", "s", "n", "rows"],
        )


def element_means(vectors: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """(label, pos, m, rows): the mean of each element of the vectors of a label, nulls left out, and how many vectors have this element.

    A batch gives a row for each of its labels and places, not for each element of each vector, and Spark adds these up; so a
    label that a third of all vectors have is no hot group. A null vector and an empty one count nowhere, a null label is a label.
    """
    kind = vectors.schema[label].dataType
    schema = T.StructType([T.StructField("label", kind), *T.StructType.fromDDL("pos int, s double, n bigint, rows bigint").fields])
    parts = vectors.select(F.col(label).alias("label"), F.col(vector).alias("vector")).mapInArrow(_partial, schema)
    total = parts.groupBy("label", "pos").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m"), F.sum("rows").alias("rows"))
    return total.select(F.col("label").alias(label), "pos", "m", "rows")
