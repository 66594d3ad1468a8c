"""Near-duplicate classes: DartMinHash sketches, a banded join on leaders, exact verification, components.

Documents of equal words collapse first. Of the distinct texts, those that
agree in all coordinates of a band fall into a bucket. A bucket is never
expanded into pairs. Its leader is the member that meets most others in all of
its buckets, and each text is compared, on the texts themselves, with the one
leader it shares most buckets with: at most one comparison a text. Since
leaders come earlier in one order of all texts, the links found are a forest,
whose trees are contracted. Buckets whose members then still belong to several
trees are settled exactly: members of different trees that can be similar
enough share one of their rarest shingles. Links between trees, few by then,
are joined into classes as components of the trees.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.dart_minhash import band_hashes, dart_sketches, shingle_cells
from tessera.operators.graph import components, forest_roots
from tessera.sources.columns import Carried
from tessera.sources.shared import Scratch, arrow_batches, dealt_anew, stage
from tessera.llm.tokens import byte_words, ragged, slices, word_hashes

WIDTH = 5
SIMILARITY = 0.8
#: A pair at similarity 0.8 shares one of 25 bands of 5 coordinates with probability 1 - (1 - 0.8**5)**25 > 0.9999.
BANDS, ROWS = 25, 5
#: Words and texts per slice of a batch: a text draws about a thousand darts, so both bound the arrays of a task to some ten MB.
SLICE, SLICE_ROWS = 50_000, 100
#: Documents and bytes of an Arrow batch, since each carries a hash for every word.
BATCH_ROWS, BATCH_BYTES = 250, 2 << 20
#: Shingles that are told apart by how often they occur, the most frequent ones; this orders shingles and drops none.
HOT_CELLS = 65_536
#: Members of one shingle that a task takes at once on one side of the join.
SALT_ROWS = 500


def _sketch_batches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, bounds = ragged(batch.column(batch.schema.get_field_index("tokens")))
            prints, sizes, keys = [], [], []
            for start, stop in slices(bounds, SLICE, SLICE_ROWS):
                own = bounds[start : stop + 1] - bounds[start]
                part = tokens[bounds[start] : bounds[stop]]
                prints += [hashlib.md5(part[a:b].tobytes()).digest() for a, b in zip(own[:-1], own[1:])]
                cells, row = shingle_cells(part, own, width)
                sizes.append(np.bincount(row, minlength=stop - start))
                keys.append(band_hashes(dart_sketches(cells, row, stop - start, bands * rows), bands, rows))
            if not prints:
                continue
            flat = pa.array(np.concatenate(keys).reshape(-1).view(np.int64))
            names = [n for n in batch.schema.names if n != "tokens"]
            columns = [batch.column(n) for n in names] + [
                pa.array(prints, pa.binary()),
                pa.array(np.concatenate(sizes).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "print", "size", "bands"])

    return run


def sketch_rows(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with uid, print (128 bits of the words), size (number of shingles) and bands; written and reread.

    uid is fixed by the writing, so it may come from the position of the row.
    """
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("uid", T.LongType()),
            T.StructField("print", T.BinaryType()),
            T.StructField("size", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    ready = docs.withColumn("uid", F.monotonically_increasing_id()).withColumn("tokens", word_hashes(F.col("text")))
    with arrow_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        return stage(ready.mapInArrow(_sketch_batches(width, bands, rows), schema), "sketches")


def shingle_counts(raw: bytes, width: int) -> Counter:
    words = byte_words(raw)
    if len(words) < width:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[i:] for i in range(width))))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets; 1 for two empty ones."""
    if len(a) > len(b):
        a, b = b, a
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 1.0


def _verify_batches(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts = None, Counter()
        for batch in batches:
            b = batch.column("b").to_pylist()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                if b[i] != last:  # after a merge join the rows of one b follow each other
                    last, counts = b[i], shingle_counts((batch.column("text_b")[i].as_py() or "").encode(), width)
                keep[i] = similarity(shingle_counts((batch.column("text_a")[i].as_py() or "").encode(), width), counts) >= least
            yield batch.filter(pa.array(keep)).drop_columns(["text_a", "text_b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The rows of ``pairs`` (long columns, a and b among them) whose texts are at least ``least`` similar."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select(*pairs.columns, "text_a", "text_b").mapInArrow(_verify_batches(width, least), ", ".join(f"{c} long" for c in pairs.columns))


def bucket_members(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node, size, met) of the buckets with two members or more; met is how many members the node's buckets have in all."""
    banded = nodes.where("size > 0").select(F.explode("bands").alias("bucket"), "node", "size")
    counts = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = banded.join(dealt_anew(counts, "n", "bucket"), "bucket")
    # a node has no more buckets than there are bands
    return scratch.stage(crowded.select("bucket", "node", "size", F.sum("n").over(Window.partitionBy("node")).alias("met")), "members")


def leader_pairs(members: DataFrame, least: float) -> DataFrame:
    """(a, b): each node with the leader that it shares most buckets with, if their sizes allow the similarity.

    Leaders are greatest by (met, -node), so every b comes after its a in one order and the pairs form a forest.
    """
    leaders = members.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("node")).alias("no"), "size")).alias("leader"))
    met = members.join(dealt_anew(leaders, "leader", "bucket"), "bucket")
    fits = F.least("size", "leader.size") >= F.greatest("size", "leader.size") * least
    near = met.where((F.col("node") != -F.col("leader.no")) & fits).select("node", "leader.met", "leader.no").repartition("node")
    shared = near.groupBy("node", "met", "no").agg(F.count("*").alias("n"))
    best = shared.groupBy("node").agg(F.max(F.struct("n", "met", "no")).alias("best"))
    return best.select(F.col("node").alias("a"), (-F.col("best.no")).alias("b"))


def _cell_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, bounds = ragged(batch.column(batch.schema.get_field_index("tokens")))
            found, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for start, stop in slices(bounds, SLICE, SLICE_ROWS):
                own = bounds[start : stop + 1] - bounds[start]
                cells, row = shingle_cells(tokens[bounds[start] : bounds[stop]], own, width)
                order = np.argsort(row, kind="stable")
                found.append(cells[order])
                sizes.append(np.bincount(row, minlength=stop - start))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("comp"), lists], names=["node", "comp", "cells"])

    return run


def _prefix_batches(hot: np.ndarray, times: np.ndarray, least: float):
    """The cells of each row in the order (times, cell), as far as a partner of at least ``least`` must share one of them.

    ``lead`` marks the shorter part that is enough for partners of the same size or larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, bounds = ragged(batch.column(batch.schema.get_field_index("cells")))
            sizes = np.diff(bounds)
            row = np.repeat(np.arange(len(sizes)), sizes)
            often = np.zeros(len(cells), dtype=np.int64)
            if len(hot):
                spot = np.minimum(np.searchsorted(hot, cells), len(hot) - 1)
                often = np.where(hot[spot] == cells, times[spot], 0)
            cells = cells[np.lexsort((cells, often, row))]
            at = np.arange(len(cells)) - bounds[:-1][row] + 1
            probe = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
            lead = sizes - np.ceil(2 * least / (1 + least) * sizes - 1e-9).astype(np.int64) + 1
            kept = at <= probe[row]
            row, at, cells = row[kept], at[kept], cells[kept]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(pa.array(row)),
                    batch.column("comp").take(pa.array(row)),
                    pa.array(sizes[row].astype(np.int64)),
                    pa.array(cells.view(np.int64)),
                    pa.array(at.astype(np.int64)),
                    pa.array(at <= lead[row]),
                ],
                names=["node", "comp", "size", "cell", "at", "lead"],
            )

    return run


def cross_pairs(current: DataFrame, texts: DataFrame, width: int, least: float, scratch: Scratch) -> DataFrame:
    """All pairs (a, b, comp_a, comp_b) of different components that can be at least ``least`` similar, among the members of open buckets.

    Similar sets share a cell among the first ones of each in any common order;
    the rarest come first. Of each cell the holders outside its largest component
    meet all others, and those of a hot cell are dealt to several tasks.
    """
    open_ones = current.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    nodes = current.join(dealt_anew(open_ones, "lo", "bucket"), "bucket").select("node", "comp").distinct()
    ready = texts.join(nodes, "node").select("node", "comp", word_hashes(F.col("text")).alias("tokens"))
    cells = scratch.stage(ready.mapInArrow(_cell_batches(width), "node long, comp long, cells array<long>"), "cells")
    counts = cells.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "cell").limit(HOT_CELLS).toArrow()
    hot, times = top.column("cell").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(hot)
    schema = "node long, comp long, size long, cell long, at long, lead boolean"
    prefix = scratch.stage(cells.mapInArrow(_prefix_batches(hot[order], times[order], least), schema), "prefix")
    held = prefix.groupBy("cell", "comp").agg(F.count("*").alias("n")).groupBy("cell")
    shared = held.agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all")).where(F.col("all") > F.col("most.n"))
    salts = F.ceil((F.col("all") - F.col("most.n")) / SALT_ROWS).cast("int")
    known = dealt_anew(shared.select("cell", F.col("most.comp").alias("main"), salts.alias("salts")), "main", "cell")
    rows = scratch.stage(prefix.join(known, "cell"), "holders")
    names = ["node", "comp", "size", "at", "lead"]
    left = rows.where("comp != main").select("cell", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), *(F.col(c).alias(f"l_{c}") for c in names))
    right = rows.select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"r_{c}") for c in names))
    smaller = F.struct("l_size", "l_node") < F.struct("r_size", "r_node")
    # of the first cell that two sets share, no more can follow than either has left
    rest = 1 + F.least(F.col("l_size") - F.col("l_at"), F.col("r_size") - F.col("r_at"))
    enough = rest >= (F.col("l_size") + F.col("r_size")) * (least / (1 + least)) - 1e-9
    fits = F.least("l_size", "r_size") >= F.greatest("l_size", "r_size") * least - 1e-9
    met = left.join(right, ["cell", "salt"]).where((F.col("l_comp") != F.col("r_comp")) & fits & enough & F.when(smaller, F.col("l_lead")).otherwise(F.col("r_lead")))
    ends = F.array_sort(F.array(F.struct(F.col("l_node").alias("node"), F.col("l_comp").alias("comp")), F.struct(F.col("r_node").alias("node"), F.col("r_comp").alias("comp"))))
    sides = met.select(F.get(ends, F.lit(0)).alias("x"), F.get(ends, F.lit(1)).alias("y"))
    return sides.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("comp_a"), F.col("y.comp").alias("comp_b")).distinct()


def linked_components(members: DataFrame, texts: DataFrame, width: int, least: float, scratch: Scratch) -> DataFrame | None:
    """(node, comp) for the nodes with a similar one, None if there are none."""
    pairs = scratch.stage(leader_pairs(members, least), "pairs")
    links = verified(pairs, texts, width, least)
    trees = forest_roots(links.select(F.col("a").alias("node"), F.col("b").alias("parent")), scratch)
    labels = trees.select("node", F.col("root").alias("comp"))
    current = members.select("bucket", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    across = scratch.stage(cross_pairs(scratch.stage(current, "current"), texts, width, least, scratch), "pairs")
    bridges = scratch.stage(verified(across, texts, width, least), "links")
    labels = labels.union(labels.select(F.col("comp").alias("node"), "comp").distinct())
    if bridges.isEmpty():
        return None if trees.isEmpty() else labels
    joined = components(bridges.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), scratch).withColumnsRenamed({"node": "tree", "comp": "whole"})
    renamed = labels.join(joined, F.col("comp") == F.col("tree"), "left").select("node", F.coalesce("whole", "comp").alias("comp"))
    # single texts that only a bridge joins have no label yet
    alone = joined.join(labels, F.col("tree") == F.col("node"), "left_anti").select(F.col("tree").alias("node"), F.col("whole").alias("comp"))
    return renamed.union(alone)


def near_classes(sketches: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """(print, keeper_uid, class_id, class_texts) for each distinct text of ``sketches``; written and reread.

    class_id is the least doc_id of the class (null if all are null), keeper_uid
    the row that stays for it.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("best")
    with Scratch(sketches.sparkSession) as scratch, arrow_batches(sketches.sparkSession, BATCH_ROWS, BATCH_BYTES):
        grouped = sketches.groupBy("print").agg(F.min("uid").alias("node"), first, F.max("size").alias("size"), F.first("bands").alias("bands"))
        nodes = scratch.stage(grouped.select("print", "node", F.col("best.doc_id").alias("doc_id"), F.col("best.uid").alias("uid"), "size", "bands"), "nodes")
        members = bucket_members(nodes, scratch)
        wanted = scratch.stage(members.select("node").distinct(), "wanted")
        texts = scratch.stage(sketches.select(F.col("uid").alias("node"), "text").join(wanted, "node", "left_semi"), "texts")
        labels = linked_components(members, texts, width, least, scratch)
        plain = nodes.drop("size", "bands")
        if labels is None:
            alone = plain.select("print", F.col("uid").alias("keeper_uid"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_texts"))
            return stage(alone, "classes")
        labelled = scratch.stage(plain.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
        best = labelled.groupBy("comp").agg(first, F.count("*").alias("class_texts"))
        classes = labelled.select("print", "comp").join(dealt_anew(best, "class_texts", "comp"), "comp")
        return stage(classes.select("print", F.col("best.uid").alias("keeper_uid"), F.col("best.doc_id").alias("class_id"), "class_texts"), "classes")


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """All rows and columns of ``docs`` with class_id, class_texts (distinct texts in the class) and is_keeper.

    Similarity is the weighted Jaccard similarity of the counts of shingles of
    ``width`` words. Texts of fewer words are one shingle; texts without words
    (null, empty) form one class of their own; a long text is one row like any
    other and costs by its words. Exactly one row of a class is the keeper: one
    of least doc_id, null ids last, one of them if ids or rows repeat. An empty
    table stays empty. Columns of the three names are replaced, all others pass
    under any name.
    """
    carried = Carried(docs, ["doc_id", "text"], ["class_id", "class_texts", "is_keeper"])
    sketches = sketch_rows(carried.df, width)
    classes = near_classes(sketches, width, least)
    # both are tables, so a class or text of very many rows can be split
    marked = sketches.drop("bands", "size").join(classes, "print").withColumn("is_keeper", F.col("uid") == F.col("keeper_uid"))
    return carried.back(marked, "class_id", "class_texts", "is_keeper")
