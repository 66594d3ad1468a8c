"""Source divergence audit: how the term frequencies of the sources of a language differ, in exact integers.

Documents are counted in Arrow batches into rows (language, term, source) before anything is shuffled. A term is kept if at
least ``min_docs`` documents of its language hold it. Kept terms are numbered within their language in UTF-8 order and dealt
to chunks of neighbouring numbers. In a task a chunk is a sorted array of terms; searchsorted gives each count its id, and
bincount adds it to the dense vector of its source. Since ids follow UTF-8 order, the first id among equal values is the
least term. Sums over chunks are longs, so their order does not matter.

With c the count of a term in a group, N the group's occurrences of kept terms and V the kept terms of the language:
p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and a difference of p and q weighs floor((p - q)^2 / (p + q)).

Defined results: a null text, language or source is ''; each row is a document, equal rows too; a group without kept terms has
rows all the same (p follows from c = 0); a language without kept terms has pairs of value 0; a language of one source has no
pairs; an empty table gives no rows; columns besides lang, source and text are left out. Counts may reach 9 * 10^15 a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.byte_terms import texts, translation
from tessera.operators.numbering import numbered
from tessera.sources.shared import arrow_batches, stage

TERMS = translation()
#: Rows that a task gathers before it hands them on.
HELD = 400_000
#: Cells of a chunk: sources times terms. The chunk's vectors take 8 bytes a cell.
CELLS = 1 << 17
SCALE_STEPS, STEP = 3, 1000  # p is scaled by STEP ** SCALE_STEPS = 10^9
COUNTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, term, source) seen, handed on whenever HELD of them are gathered."""
    occurrences: dict[tuple[str, str], Counter[bytes]] = {}
    documents: dict[tuple[str, str], Counter[bytes]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            terms, docs = list(counts), documents[lang, source]
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(counts.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=COUNTS)
        occurrences.clear()
        documents.clear()

    held = 0
    for batch in batches:
        for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts(batch.column("text")), strict=True):
            found = Counter(raw.translate(TERMS).split())
            if not found:
                continue
            total, docs = (of.setdefault((lang, source), Counter()) for of in (occurrences, documents))
            before = len(total)
            total.update(found)
            docs.update(found.keys())
            held += len(total) - before
            if held >= HELD:
                yield from rows()
                held = 0
    yield from rows()


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, counts): the terms that at least ``min_docs`` documents of a language hold, with (source, n) of each of its sources."""
    counts = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, term string, source string, n bigint, docs bigint")
    grouped = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = grouped.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "counts")


def _dense(key: tuple, rows: pa.Table) -> pa.Table:
    """One row: the sorted terms of a chunk and for each source that has any the vector of its counts."""
    terms = np.array(rows.column("term").cast(pa.binary()).to_pylist(), dtype=object)
    kept = np.sort(terms)
    counts = rows.column("counts").combine_chunks()
    counts = pa.concat_arrays(counts.chunks) if isinstance(counts, pa.ChunkedArray) else counts
    flat = counts.flatten()
    ids = np.searchsorted(kept, terms)[np.repeat(np.arange(len(terms)), counts.value_lengths().to_numpy())]
    sources, of = np.unique(np.array(flat.field("source").to_pylist(), dtype=object), return_inverse=True)
    cells = of * len(kept) + ids
    n, size = flat.field("n").to_numpy(), len(sources) * len(kept)
    low, high = (np.bincount(cells, part, size).astype(np.int64) for part in (n & 0xFFFFFFFF, n >> 32))  # exact in doubles
    vectors = ((high << 32) + low).reshape(len(sources), len(kept))
    return pa.table(
        {"lang": [key[0].as_py()], "chunk": [key[1].as_py()], "terms": [kept.tolist()], "sources": [sources.tolist()], "vectors": [[v.tobytes() for v in vectors]]},
        schema=pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.string())), ("vectors", pa.list_(pa.binary()))]),
    )


def scaled(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (c + 2) / (N + 2 V)), by long division in steps of three digits, so that no product leaves 64 bits."""
    base = total + 2 * terms
    quotient, rest = np.zeros_like(counts), counts + 2
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * STEP, base)
        quotient = quotient * STEP + digit
    return quotient + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


COMPARED = "lang string, source string, part string, item string, value bigint"


def _compared(most: int):
    """Of each chunk the summed divergences of all pairs of sources, and of each source its ``most`` best terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                lang, kept = row["lang"], row["terms"] or []
                groups = sorted((g["source"].encode(), g["n"]) for g in row["groups"])
                names, width = [g[0].decode() for g in groups], len(kept)
                at = {name: i for i, name in enumerate(names)}
                counts = np.zeros((len(names), width), np.int64)
                for source, vector in zip(row["sources"] or [], row["vectors"] or [], strict=True):
                    counts[at[source]] = np.frombuffer(vector, np.int64)
                v = row["v"] or 0
                totals = [n for _, n in groups]
                p = np.stack([scaled(c, n, v) for c, n in zip(counts, totals, strict=True)]) if v else np.ones((len(names), 0), np.int64)
                for i, name in enumerate(names):
                    sums = divergence(p[i], p).sum(axis=1)
                    others = [j for j in range(len(names)) if j != i]
                    if others:
                        yield pa.RecordBatch.from_arrays([[lang] * len(others), [name] * len(others), ["pair"] * len(others), [names[j] for j in others], pa.array(sums[others], pa.int64())], schema=schema)
                if not width:
                    continue
                q = scaled(counts.sum(axis=0), sum(totals), v)
                for i, name in enumerate(names):
                    better = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                    values = divergence(p[i][better], q[better])
                    best = np.argsort(-values, kind="stable")[:most]  # ids follow UTF-8 order, so the first of equals is the least term
                    if len(best):
                        items = [kept[j].decode() for j in better[best]]
                        yield pa.RecordBatch.from_arrays([[lang] * len(items), [name] * len(items), ["term"] * len(items), items, pa.array(values[best], pa.int64())], schema=schema)

    return run


def source_divergence(documents: DataFrame, min_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and the terms that a source uses more than its language does."""
    spark = documents.sparkSession
    docs = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = stage(docs.select("lang", "source").distinct(), "groups")
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(16, min(1 << 16, CELLS // widest))
    with arrow_batches(spark, 2000):  # the numbering writes what it has counted
        kept = numbered(kept_terms(docs, min_docs), ["lang"], ["term"], "id")
    chunked = kept.withColumn("chunk", F.floor(F.col("id") / width))
    vectors = stage(chunked.groupBy("lang", "chunk").applyInArrow(_dense, "lang string, chunk bigint, terms array<binary>, sources array<string>, vectors array<binary>"), "vectors")
    # totals of the groups and of the languages
    occurrences = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    totals = groups.join(occurrences, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = vectors.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    languages = totals.groupBy("lang").agg(F.collect_list(F.struct("source", "n")).alias("groups")).join(sizes, "lang", "left")
    # each chunk gets the totals of its language; chunk -1 has no terms and stands for all pairs
    chunks = vectors.select("lang", "chunk").union(languages.select("lang", F.lit(-1).cast("bigint")))
    told = chunks.join(languages, "lang")
    met = told.join(vectors, ["lang", "chunk"], "left")
    with arrow_batches(spark, 1):
        parts = stage(met.mapInArrow(_compared(most_terms), COMPARED), "parts")
    summed = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    pairs = summed.withColumn("rank", F.row_number().over(place))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most_terms)
    return pairs.unionByName(terms)
