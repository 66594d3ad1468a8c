"""Ranked lexical search over a bit-sliced impact index.

Two passes over the documents. The first counts in Arrow batches which terms of the queries each document holds, and how many
terms it has; from these rows follow the statistics of all documents. The second turns each batch into an index: the documents
of a batch in order of their ids are the bits of a bitmap, and each term has one bitmap for each bit of its impacts. The scores
of a query are sums of such numbers, made for all documents of a bitmap at once by bitwise addition with carry. The best are
found from the most significant slice down: candidates with a set bit stay if they are more than wanted, or are taken if fewer.
What is left in the end is equal in score, and its first bits have the least ids.

A term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))), an impact w ((10^9 tf) div (1000 tf + 12 m)) with
m = 75 + (25 n N) div L. A query's score sums the impacts of its terms, repeats included.

Queries are a stated set: they reach the tasks in blocks of BLOCK bytes of text, each of which reads all documents. A task
keeps the best documents of each query of the block, so the rows that leave it follow the queries, not the documents.

Defined results: a null or empty text, of a document or a query, has no terms and no results; equal documents are ranked each,
in any order; ids may be of any type, null ids come last among equal scores; equal queries (id and text) count once, queries
of equal id and different texts are ranked each; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.byte_terms import texts, translation
from tessera.sources.shared import Scratch, arrow_batches, shared_path

TERMS = translation(b"0123456789")
#: Bytes of query text in a block.
BLOCK = 4 << 20
#: Documents of a batch of the index, and queries that are added up together.
DOCUMENTS, TOGETHER = 8192, 64
#: Terms times documents of the bitmaps that a task holds at a time: 8 Mbit for each slice.
CELLS = 1 << 23


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TERMS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _postings(vocabulary):
    """(doc_id, n, ids, tfs): the terms of a document, and those of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            sizes, bounds, ids, tfs = [], [0], [], []
            for raw in texts(batch.column("text")):
                found = Counter(tokens := terms_of(raw))
                held = found.keys() & known.keys()
                sizes.append(len(tokens))
                ids += [known[t] for t in held]
                tfs += [found[t] for t in held]
                bounds.append(len(ids))
            lists = (pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, pa.int32())) for v in (ids, tfs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    return run


def sliced(terms: np.ndarray, places: np.ndarray, impacts: np.ndarray, n_terms: int, n_places: int) -> np.ndarray:
    """Bitmaps [bit, term, word] of impacts at (term, place), sorted by both; the last term has none and stands for absent ones."""
    words = -(-n_places // 64)
    out = np.zeros((int(impacts.max(initial=0)).bit_length(), n_terms + 1, words), np.uint64)
    at = terms * words + (places >> 6)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    own = np.uint64(1) << (places & 63).astype(np.uint64)
    for b, bitmap in enumerate(out):
        bitmap.reshape(-1)[at[starts]] = np.bitwise_or.reduceat(np.where((impacts >> b) & 1, own, np.uint64(0)), starts)
    return out


def added(slices: np.ndarray, queries: list[np.ndarray]) -> np.ndarray:
    """Bitmaps [bit, query, word] of the sums of each query's terms; queries by descending number of terms."""
    longest = max(map(len, queries))
    top = slices.shape[0] + longest.bit_length()
    sums = np.zeros((top, len(queries), slices.shape[2]), np.uint64)
    for k in range(longest):
        now = [q[k] for q in queries if len(q) > k]
        carry = np.zeros((len(now), slices.shape[2]), np.uint64)
        for b in range(top):
            a = sums[b, : len(now)]
            if b < len(slices):
                x = slices[b, now]
                both, one = a & x, a ^ x
                sums[b, : len(now)] = one ^ carry
                carry = both | (one & carry)
            elif carry.any():
                a, carry = a ^ carry, a & carry
                sums[b, : len(now)] = a
            else:
                break
    return sums


def best(sums: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps [query, word] of the documents that surely are among the ``most`` best, and of those that tie for what is left."""
    open_, sure = np.bitwise_or.reduce(sums, axis=0), np.zeros(sums.shape[1:], np.uint64)
    for s in sums[::-1]:
        high = open_ & s
        count = np.bitwise_count(sure | high).sum(axis=1, dtype=np.int64)
        many, few = (count > most)[:, None], (count <= most)[:, None]
        sure = np.where(few, sure | high, sure)
        open_ = np.where(many, high, open_ & ~s)
        open_[count == most] = 0
    return sure, open_


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """A block of queries with what the tasks need of the corpus."""

    def __init__(self, queries: list[list[int]], weights: list[int], documents: int, terms: int) -> None:
        self.queries = [np.array(q, np.int64) for q in queries]
        self.weights = np.array(weights, np.int64)
        self.documents, self.terms = documents, terms

    def impacts(self, ids: np.ndarray, tfs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of postings with their documents' numbers of terms; 64-bit numbers, wider where 25 n N does not fit."""
        if len(n) and 25 * int(n.max()) * self.documents >= 1 << 63:
            m = 75 + np.array([25 * int(x) * self.documents // self.terms for x in n], np.int64)
        else:
            m = 75 + 25 * n * self.documents // self.terms
        return self.weights[ids] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m))

    def found(self, batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores): the best rows of a batch whose rows are in the order of ids."""
        lists = batch.column("ids")
        rows = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
        ids, tfs = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("ids", "tfs"))
        impacts = self.impacts(ids, tfs, batch.column("n").to_numpy()[rows])
        present = np.zeros(len(self.weights), bool)
        present[ids[impacts > 0]] = True
        order = np.lexsort((rows, ids))
        ids, rows, impacts = ids[order], rows[order], impacts[order]
        short = [(q, kept) for q, terms in enumerate(self.queries) if len(kept := terms[present[terms]])]
        short.sort(key=lambda x: -len(x[1]))
        for at in range(0, len(short), TOGETHER):
            group = short[at : at + TOGETHER]
            needed = np.unique(np.concatenate([t for _, t in group]))
            own = np.isin(ids, needed) & (impacts > 0)
            width = max(64, min(len(batch), CELLS // len(needed)) // 64 * 64)
            queries = [np.searchsorted(needed, t) for _, t in group]
            for start in range(0, len(batch), width):
                here = own & (rows >= start) & (rows < start + width)
                slices = sliced(np.searchsorted(needed, ids[here]), rows[here] - start, impacts[here], len(needed), min(width, len(batch) - start))
                if not len(slices):
                    continue
                sums = added(slices, queries)
                sure, tied = best(sums, most)
                for i, (q, _) in enumerate(group):
                    places = _places(sure[i])
                    if len(places) < most:
                        places = np.concatenate([places, _places(tied[i])[: most - len(places)]])
                    if len(places):
                        bits = (sums[:, i, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
                        scores = (bits.astype(np.int64) << np.arange(len(sums))[:, None]).sum(axis=0)
                        yield q, places + start, scores


def _searched(block, most: int, first: int, item_ids: list, item_type: pa.DataType):
    """(no, item_id, doc_id, score): of each query the best documents of a task."""

    def key(x: tuple) -> tuple:
        score, doc = x
        return (-score, doc is None, 0 if doc is None else doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {}
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            batch = batch.take(pc.sort_indices(batch.column("doc_id"), null_placement="at_end"))
            docs = batch.column("doc_id")
            for q, rows, scores in block.value.found(batch, most):
                new = zip(scores.tolist(), docs.take(pa.array(rows)).to_pylist(), strict=True)
                kept[q] = sorted([*kept.get(q, []), *new], key=key)[:most]
        if kept:
            flat = [(q, s, d) for q, pairs in kept.items() for s, d in pairs]
            columns = [pa.array([first + q for q, _, _ in flat], pa.int64()), pa.array([item_ids[q] for q, _, _ in flat], item_type), pa.array([d for _, _, d in flat], doc_type), pa.array([s for _, s, _ in flat], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["no", "item_id", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The queries (id, terms), a block at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        raw = (row["text"] or "").encode()
        if block and size + len(raw) > BLOCK:
            yield block
            block, size = [], 0
        block.append((row["item_id"], terms_of(raw)))
        size += len(raw)
    if block:
        yield block


def ranked_documents(documents: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents of each row (item_id, text) of ``items``, those of score 0 left out."""
    spark = documents.sparkSession
    item, doc = items.schema["item_id"], documents.schema["doc_id"]
    rows = T.StructType([T.StructField("no", T.LongType()), T.StructField("item_id", item.dataType), T.StructField("doc_id", doc.dataType), T.StructField("score", T.LongType())])
    counts = T.StructType([T.StructField("doc_id", doc.dataType), *T.StructType.fromDDL("n bigint, ids array<int>, tfs array<int>").fields])
    path, first = shared_path(spark, "found"), 0
    spark.createDataFrame([], rows).write.parquet(path)
    for queries in _blocks(items):
        with Scratch(spark) as scratch:
            numbers: dict[bytes, int] = {}
            numbered = [[numbers.setdefault(t, len(numbers)) for t in terms] for _, terms in queries]
            vocabulary = spark.sparkContext.broadcast(numbers)
            with arrow_batches(spark, 2000):
                postings = scratch.stage(documents.select("doc_id", "text").mapInArrow(_postings(vocabulary), counts), "postings")
            total = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
            holding = {r["id"]: r["count"] for r in postings.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator()}
            weights = [weight(total["documents"], holding.get(i, 0)) for i in range(len(numbers))]
            block = spark.sparkContext.broadcast(Block(numbered, weights, total["documents"], total["terms"] or 1))
            with arrow_batches(spark, DOCUMENTS):
                searched = postings.mapInArrow(_searched(block, most, first, [i for i, _ in queries], to_arrow_type(item.dataType)), rows)
                searched.write.mode("append").parquet(path)
            vocabulary.destroy()
            block.destroy()
        first += len(queries)
    place = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = spark.read.schema(rows).parquet(path).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)
    return found.select("item_id", "rank", "doc_id", "score")
