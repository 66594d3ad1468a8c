"""Quality rules: fixed base rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one from the trusted
target (labelled good documents), one from the raw corpus. The score of a
document is the log-likelihood ratio of its n-grams divided by their number.
The threshold comes from the scores of all labelled documents: the cut that
separates good from bad ones best. Every document is then decided by the same
comparison; nothing is drawn at random.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tokens import mix, slices
from tessera.sources.columns import Carried
from tessera.sources.shared import arrow_batches, stage

#: Characters that count as symbols (a fixed value of the rules).
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Lengths in bytes of the n-grams.
GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
#: At most so many labelled good documents, those of least hash, make up the target.
TARGET_DOCS = 20_000
#: Width of the bins in which scores of labelled documents are compared.
BIN = 0.005
#: Bytes of text whose n-grams are arrays at once, and rows of an Arrow batch: both bound the memory of a task.
SLICE = 250_000
BATCH_ROWS = 2000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COLUMNS = [*FEATURES, "base_failed", "score", "kept"]
WORD = re.compile(rb"[^\x20\x09-\x0D]")


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """The five counts of FEATURES of a UTF-8 text."""
    words = raw.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if WORD.search(line)]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            covered = 0  # words before this index are counted already
            for i, window in enumerate(windows):
                if times[window] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def gram_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and the row of each; none crosses from one text to the next."""
    lengths = np.diff(bounds)
    row = np.repeat(np.arange(len(lengths)), lengths)
    left = bounds[1:][row] - np.arange(len(data))  # bytes from here to the end of the text
    buckets, rows = [], []
    with np.errstate(over="ignore"):
        value = np.zeros(len(data), dtype=np.uint64)
        for n in range(1, max(GRAMS) + 1):
            shifted = np.zeros(len(data), dtype=np.uint64)
            shifted[: max(len(data) - n + 1, 0)] = data[n - 1 :]
            value = value | shifted << np.uint64(8 * (n - 1))
            if n in GRAMS:
                fits = left >= n
                buckets.append((mix(value[fits] + np.uint64(n << 56)) & np.uint64(BUCKETS - 1)).astype(np.int64))
                rows.append(row[fits])
    return np.concatenate(buckets), np.concatenate(rows)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: n-gram counts of all texts and of those flagged ``target``."""
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        data, bounds = _texts(batch.column("text"))
        chosen = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for start, stop in slices(bounds, SLICE):
            own = bounds[start : stop + 1] - bounds[start]
            buckets, rows = gram_buckets(data[bounds[start] : bounds[stop]], own)
            raw += np.bincount(buckets, minlength=BUCKETS)
            target += np.bincount(buckets[chosen[start:stop][rows]], minlength=BUCKETS)
    seen = np.nonzero(raw)[0]
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])


def ratio_table(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw), smoothed by one; all zero where nothing is labelled good.

    What reaches the driver is BUCKETS rows and the ids of at most TARGET_DOCS
    labelled documents.
    """
    good = (
        labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TARGET_DOCS)
        .withColumn("target", F.lit(True))
    )
    flagged = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left")
    counted = flagged.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(_count_batches, "bucket int, raw long, target long")
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _score_batches(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = table.value
        for batch in batches:
            data, bounds = _texts(batch.column("text"))
            counts, scores = [], []
            for start, stop in slices(bounds, SLICE):
                own = bounds[start : stop + 1] - bounds[start]
                part = data[bounds[start] : bounds[stop]]
                whole = part.tobytes()
                counts += [base_counts(whole[a:b]) for a, b in zip(own[:-1], own[1:])]
                buckets, rows = gram_buckets(part, own)
                total = np.bincount(rows, weights=ratios[buckets], minlength=stop - start)
                scores.append(total / np.maximum(np.bincount(rows, minlength=stop - start), 1))
            table_of = np.array(counts, dtype=np.int64).reshape(-1, len(FEATURES))
            columns = [batch.column(n) for n in batch.schema.names] + [pa.array(table_of[:, i]) for i in range(len(FEATURES))]
            columns.append(pa.array(np.concatenate(scores) if scores else np.zeros(0)))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *FEATURES, "score"])

    return run


def best_cut(scored: DataFrame, labels: DataFrame) -> float:
    """The score below which documents are rejected; minus infinity unless both good and bad ones are labelled.

    All labelled documents count. Of the cuts between occupied bins the one with
    the greatest (good kept) + (bad rejected), in shares, is taken, the lowest
    of equal ones; it lies in the middle of the empty bins there.
    """
    marked = labels.select("doc_id", (F.col("quality") == 1).alias("good")).where("good is not null and doc_id is not null").distinct()
    # scores are means of bounded log ratios, so the bins are some thousands at most
    bins = (
        scored.where("not base_failed")
        .select("doc_id", F.floor(F.col("score") / BIN).cast("int").alias("bin"))
        .join(marked, "doc_id")
        .groupBy("bin")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
        .orderBy("bin")
        .collect()
    )
    goods, bads = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not goods or not bads:
        return float("-inf")
    best, cut, good, bad = 1.0, float("-inf"), 0, 0
    for r, above in zip(bins, [*bins[1:], bins[-1]]):
        good, bad = good + r["good"], bad + r["bad"]
        gain = (goods - good) / goods + bad / bads
        if gain > best:
            best, cut = gain, (r["bin"] + 1 + max(above["bin"], r["bin"] + 1)) / 2 * BIN
    return cut


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with n_words ... n_repeat_words, base_failed, score and kept.

    A null text counts as empty: no words, score 0, failed. Long texts are
    scored whole, repeated rows alike, and a score equal to the cut is kept. An
    empty table stays empty. Labels with null ids or grades don't count; a
    document labelled both ways counts for both. Columns of ``docs`` with the
    names of COLUMNS are replaced, all others pass under any name.
    """
    spark = docs.sparkSession
    carried = Carried(docs, ["doc_id", "text"], COLUMNS)
    table = spark.sparkContext.broadcast(ratio_table(carried.df, labels))
    kinds = [T.LongType()] * len(FEATURES) + [T.DoubleType()]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in carried.df.schema.fields] + [T.StructField(n, k) for n, k in zip([*FEATURES, "score"], kinds)])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    with arrow_batches(spark, BATCH_ROWS):
        scored = stage(carried.df.mapInArrow(_score_batches(table), schema).withColumn("base_failed", failed), "scores")
    cut = best_cut(scored, labels)
    return carried.back(scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut))), *COLUMNS)
