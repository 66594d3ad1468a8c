"""Bigram language model by deleted interpolation, trained and applied on a corpus of any size.

    P(w | v) = a(b) c(v, w) / c(v) + b(b) c(w) / N + r(b) / (V + 1)

mixes maximum-likelihood estimates; the three weights depend on the bucket b of
the context frequency c(v) (powers of two). They are learned by expectation
maximisation on a deleted part of the training texts, with the counts of the
other training texts only; the final counts are those of all training texts.

Nothing is broadcast but the weights. Texts become blocks of some million
tokens, written once. Each block sends its distinct n-grams, as sorted 64-bit
hashes with their counts, to the hash ranges (buckets of n-grams) they belong
to; a range adds up what all blocks sent and answers each with the totals. An
n-gram of a third of all tokens is one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch, arrow_batches, stage
from tessera.llm.tokens import mix, ragged, slices, word_hashes

TRAIN, DELETED, HELD_OUT = 0, 1, 2
#: Tokens of a block: bounds the arrays of a task to some tens of MB.
BLOCK_TOKENS = 1_600_000
#: Texts of an Arrow batch, since each carries a hash for every word.
BATCH_ROWS = 1000
#: Rows of one batch on the way to the ranges.
SENT_ROWS = 1024
#: Context frequencies 0, 1, 2-3, 4-7, ... up to 2**46 and above.
CONTEXT_BUCKETS = 48
EM_STEPS = 12
FLOOR = 1e-6
END = np.uint64(0xE7037ED1A0B428DB)
SPREAD = np.uint64(0x9E3779B97F4A7C15)

BLOCK_SCHEMA = "block long, doc_ids array<long>, parts binary, lengths binary, words binary, tokens binary, n_tokens long, n_train long, n_deleted long"
KEY_SCHEMA = "kind int, bucket int, block long, keys binary, train binary, deleted binary"
TOTAL_SCHEMA = "kind int, bucket int, block long, train binary, deleted binary, known long"
COUNT_SCHEMA = "doc_ids array<long>, parts binary, lengths binary, pair binary, context binary, word binary, em_pair binary, em_context binary, em_word binary"


def pack(values: np.ndarray) -> bytes:
    """Nonnegative integers as compressed byte planes, in four bytes each where that is enough."""
    values = np.ascontiguousarray(values)
    wide = len(values) > 0 and int(values.max()) >= 1 << 32
    raw = values.astype(np.uint64 if wide else np.uint32)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return bytes([raw.itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    size, n = blob[0], int.from_bytes(blob[1:9], "little")
    planes = pa.decompress(blob[9:], n * size, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(size, n).T.copy().view(np.uint64 if size == 8 else np.uint32).reshape(n).astype(np.int64 if size == 4 else np.uint64)


def _block(number: int, ids: list[pa.Array], parts: list[np.ndarray], texts: list[tuple[np.ndarray, np.ndarray]]) -> list:
    """A row of BLOCK_SCHEMA: the tokens as ranks of the block's own words, each text ending in END."""
    lengths = np.concatenate([np.diff(bounds) for _, bounds in texts]) + 1
    hashes = np.full(int(lengths.sum()), END, dtype=np.uint64)
    inner = np.ones(len(hashes), dtype=bool)
    inner[np.cumsum(lengths) - 1] = False
    hashes[inner] = np.concatenate([values for values, _ in texts])
    words, places, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    part = np.concatenate(parts)
    sizes = {p: int(lengths[part == p].sum()) for p in (TRAIN, DELETED)}
    block = TaskContext.get().partitionId() << 24 | number
    return [block, pa.concat_arrays(ids), pack(part), pack(lengths), pack(words[order]), pack(rank[places]), len(hashes), sum(sizes.values()), sizes[DELETED]]


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, *[pa.int64()] * 3]
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]

    def emit(row: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.to_pylist() if isinstance(x, pa.Array) else x], k) for x, k in zip(row, kinds)], names=names)

    ids, parts, texts, held, number = [], [], [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values, bounds = ragged(batch.column("hashes"))
        for start, stop in slices(bounds, BLOCK_TOKENS):  # a batch may hold several blocks' worth
            size = int(bounds[stop] - bounds[start])
            if held and held + size > BLOCK_TOKENS:
                yield emit(_block(number, ids, parts, texts))
                ids, parts, texts, held, number = [], [], [], 0, number + 1
            ids.append(batch.column("doc_id").slice(start, stop - start))
            parts.append(batch.column("part").to_numpy()[start:stop])
            texts.append((values[bounds[start] : bounds[stop]].copy(), bounds[start : stop + 1] - bounds[start]))
            held += size
    if ids:
        yield emit(_block(number, ids, parts, texts))


def make_blocks(docs: DataFrame, part: Column, scratch: Scratch) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.cast("int").alias("part"), word_hashes(F.col("text")).alias("hashes"))
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return scratch.stage(rows.mapInArrow(_block_batches, BLOCK_SCHEMA), "blocks")


class Block:
    """The n-grams of a block in a form that both directions of the exchange derive alike."""

    def __init__(self, row: dict) -> None:
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        words = unpack(row["words"]).astype(np.uint64)
        self.part = np.repeat(unpack(row["parts"]).astype(np.int64), self.lengths)
        self.end = int(np.nonzero(words == END)[0][0])
        # the first token of a text follows the END of the text before: END as a context is the start
        self.context = np.roll(self.tokens, 1)
        self.context[np.cumsum(self.lengths) - self.lengths] = self.end
        with np.errstate(over="ignore"):
            self.word_keys = mix(words + SPREAD)
            pairs = mix(mix(words)[self.context] * SPREAD + words[self.tokens])
        self.pair_keys, self.pair_of = np.unique(pairs, return_inverse=True)
        self.word_order = np.argsort(self.word_keys, kind="stable")

    def counts(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the words by key and of the pairs by key, in the texts of ``part`` (TRAIN: with the deleted ones)."""
        chosen = self.part == DELETED if part == DELETED else self.part != HELD_OUT
        words = np.bincount(self.tokens[chosen], minlength=len(self.word_keys))[self.word_order]
        return words, np.bincount(self.pair_of[chosen], minlength=len(self.pair_keys))


def range_cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The equal ranges of the hash space that the sorted ``keys`` touch, and where each starts and ends in them."""
    held = (keys // np.uint64((1 << 64) // buckets + 1)).astype(np.int64)
    starts = np.flatnonzero(np.diff(held, prepend=-1))
    return held[starts], np.append(starts, len(keys))


def _key_batches(buckets: int):
    """Rows of KEY_SCHEMA; a block sends one to each range that it has an n-gram in, so never more than it has n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in KEY_SCHEMA.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                train, deleted = block.counts(TRAIN), block.counts(DELETED)
                for kind, keys in ((0, block.word_keys[block.word_order]), (1, block.pair_keys)):
                    ranges, cuts = range_cuts(keys, buckets)
                    for at in range(0, len(ranges), SENT_ROWS):
                        out = [
                            (kind, int(r), row["block"], pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(train[kind][a:b]), pack(deleted[kind][a:b]))
                            for r, a, b in zip(ranges[at : at + SENT_ROWS], cuts[at:], cuts[at + 1 :])
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """The totals of a range for each block that asked, and once the number of its keys known from training."""
    with np.errstate(over="ignore"):
        keys = [np.cumsum(unpack(k).astype(np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    answers = {}
    for name in ("train", "deleted"):
        sent = np.concatenate([unpack(c).astype(np.int64) for c in table.column(name).to_pylist()])
        totals = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(totals, places, sent)
        answers[name] = [pack(x) for x in np.split(totals[places], ends)]
        if name == "train":
            known = int((totals > 0).sum())
    return pa.table(
        {
            "kind": table.column("kind"), "bucket": table.column("bucket"), "block": table.column("block"),
            "train": pa.array(answers["train"], pa.binary()), "deleted": pa.array(answers["deleted"], pa.binary()),
            "known": pa.array([known] + [0] * (table.num_rows - 1), pa.int64()),
        }
    )


def _look_up(blocks: pa.Table, totals: pa.Table) -> pa.Table:
    """Counts of each token's pair, context and word; for deleted texts also those without the deleted part."""
    names = [x.split()[0] for x in COUNT_SCHEMA.split(", ")]
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 8]
    row = blocks.to_pylist()[0]
    block = Block(row)
    answers = sorted(totals.to_pylist(), key=lambda t: (t["kind"], t["bucket"]))

    def of(name: str) -> tuple[np.ndarray, np.ndarray]:
        words, pairs = (np.concatenate([unpack(t[name]).astype(np.int64) for t in answers if t["kind"] == kind]) for kind in (0, 1))
        by_rank = np.empty(len(words), dtype=np.int64)
        by_rank[block.word_order] = words
        return by_rank, pairs

    words, pairs = of("train")
    gone_words, gone_pairs = of("deleted")
    chosen = block.part == DELETED
    left_words, left_pairs = words - gone_words, pairs - gone_pairs
    out = [
        row["doc_ids"], row["parts"], row["lengths"],
        pack(pairs[block.pair_of]), pack(words[block.context]), pack(words[block.tokens]),
        pack(left_pairs[block.pair_of][chosen]), pack(left_words[block.context][chosen]), pack(left_words[block.tokens][chosen]),
    ]
    return pa.table([pa.array([x], k) for x, k in zip(out, kinds)], names=names)


def context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(np.float64))[1], CONTEXT_BUCKETS - 1)


def estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """(3, n): maximum-likelihood bigram and unigram, and uniform."""
    return np.stack([pair / np.maximum(context, 1), word / max(total, 1), np.full(len(pair), 1.0 / (vocabulary + 1))])


def _expectation(weights: np.ndarray, total: int, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CONTEXT_BUCKETS, 3))
        for batch in batches:
            for row in batch.to_pylist():
                pair, context, word = (unpack(row[n]).astype(np.int64) for n in ("em_pair", "em_context", "em_word"))
                bucket = context_bucket(context)
                share = estimates(pair, context, word, total, vocabulary) * weights[bucket].T
                share /= share.sum(axis=0)
                for i in range(3):
                    sums[:, i] += np.bincount(bucket, weights=share[i], minlength=CONTEXT_BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CONTEXT_BUCKETS), pa.int32()), *(pa.array(sums[:, i]) for i in range(3))], names=["bucket", "pair", "word", "rest"]
        )

    return run


def learn_weights(counted: DataFrame, total: int, vocabulary: int, steps: int = EM_STEPS) -> np.ndarray:
    """(CONTEXT_BUCKETS, 3) weights by expectation maximisation; a step is one pass over the deleted texts.

    A bucket without tokens keeps its start. One pseudo-token keeps every
    weight above zero, except that of the bigram where its context is unknown.
    """
    weights = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    tuples = counted.select("em_pair", "em_context", "em_word")
    for _ in range(steps):
        rows = tuples.mapInArrow(_expectation(weights, total, vocabulary), "bucket int, pair double, word double, rest double")
        sums = np.zeros((CONTEXT_BUCKETS, 3))
        for r in rows.groupBy("bucket").agg(F.sum("pair").alias("pair"), F.sum("word").alias("word"), F.sum("rest").alias("rest")).collect():
            sums[r["bucket"]] = [r["pair"], r["word"], r["rest"]]
        new = (sums + weights) / (sums + weights).sum(axis=1, keepdims=True)
        if np.abs(new - weights).max() < 1e-4:
            weights = new
            break
        weights = new
    weights = np.maximum(weights, FLOOR)
    weights[0, 0] = 0
    return weights / weights.sum(axis=1, keepdims=True)


def _score_batches(weights: np.ndarray, total: int, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = unpack(row["lengths"]).astype(np.int64)
                pair, context, word = (unpack(row[n]).astype(np.int64) for n in ("pair", "context", "word"))
                mixed = (estimates(pair, context, word, total, vocabulary) * weights[context_bucket(context)].T).sum(axis=0)
                starts = np.cumsum(lengths) - lengths
                base = np.log10((word + 1.0) / (total + 1.0 * (vocabulary + 1)))
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(unpack(row["parts"]) == HELD_OUT),
                    pa.array(lengths),
                    pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(np.log10(mixed), starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_corpus(docs: DataFrame, part: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    ``part`` says TRAIN, DELETED or HELD_OUT for each row; DELETED rows belong
    to the training texts. A null or empty text is one END. Rows of equal id,
    repeated ones too, are texts of their own; a long text is a block of its
    own. An empty table gives an empty one. Further columns don't pass, whatever
    their names. Without training texts every estimate but the
    uniform one is zero, and without deleted ones the weights keep their start.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    blocks = make_blocks(docs, part, scratch)
    size = blocks.agg(F.sum("n_tokens").alias("all"), F.sum("n_train").alias("train")).first()
    total = size["train"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size["all"] or 0) // BLOCK_TOKENS + 1)
    keys = blocks.mapInArrow(_key_batches(buckets), KEY_SCHEMA)
    totals = scratch.stage(keys.groupBy("kind", "bucket").applyInArrow(_add_up, TOTAL_SCHEMA), "totals")
    vocabulary = totals.where("kind = 0").agg(F.sum("known")).first()[0] or 0
    counted = stage(blocks.groupBy("block").cogroup(totals.drop("known").groupBy("block")).applyInArrow(_look_up, COUNT_SCHEMA), "counted")
    scratch.clear()
    weights = learn_weights(counted, total, vocabulary)
    scored = counted.drop("em_pair", "em_context", "em_word").mapInArrow(
        _score_batches(weights, total, vocabulary), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
