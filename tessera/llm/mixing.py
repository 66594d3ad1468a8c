"""Mixing by soft membership: domain posteriors, then document rates by projected gradient.

A classifier trained on the labelled table gives every document a posterior
over the domains clean, toxic and junk. A document of t words and posterior p
counts t * p_k words towards domain k, times its rate x. The rates minimise

    1/2 * sum over k of (sum over d of t_d p_dk x_d - T_k)^2 / N_k,   0 <= x <= max_rate

from x = 1, where N_k are the words of domain k at rate one and T_k its target.
Steps are taken in the inner product weighted by words, so documents of equal
posterior keep equal rates whatever their length. Posteriors are whole
thousandths, so all documents of one posterior are one row of a table of at
most (UNIT + 1) (UNIT + 2) / 2 rows, and a step is one aggregation over it. Its
sums are exact decimals: they do not depend on the order of the rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.columns import Carried
from tessera.sources.shared import Scratch, arrow_batches, stage

DOMAINS = ["clean", "toxic", "junk"]
#: Shares of all words that the mixture should have.
TARGETS = {"clean": 0.97, "toxic": 0.0, "junk": 0.03}
#: Words of the classifier, the most telling ones of the labelled documents.
FEATURES = 300
#: Beginnings of words count where they make up at least such shares of a text: inflected and compounded words rarely recur whole.
HEAD, HEAD_SHARES, HEAD_FEATURES = 5, (0.006, 0.012), 60
#: At most so many labelled documents train the classifier, those of least hash.
TRAIN_DOCS = 40_000
#: Posteriors are multiples of 1 / UNIT.
UNIT = 1000
STEPS = 60
TOLERANCE = 1e-4
BATCH_ROWS = 2000
#: Runs of other ASCII characters than letters and digits part words, as white space of any kind does.
PARTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
SYMBOLS = re.compile(rb"[!-/:-@\[-`{-~]{1,2}(?![!-/:-@\[-`{-~])")


def text_parts(text: str | None) -> tuple[set[str], list[str], int]:
    """Tokens that occur, words in order and the number of words parted by ASCII white space.

    Tokens are the lower-cased words and, after a tab, the last two characters of each run of symbols.
    """
    raw = (text or "").lower().encode()
    found = raw.translate(PARTS).decode().split()
    return set(found).union("\t" + s.decode() for s in set(SYMBOLS.findall(raw))), found, len(raw.split())


def head_counts(words: list[str]) -> Counter:
    """How often each beginning of HEAD letters occurs."""
    return Counter(map(itemgetter(slice(HEAD)), words))


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, y): 1 toxic, 2 bad but not toxic, 0 good; rows without an id or a grade don't count, the worst of several does."""
    y = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).when(F.col("quality") == 1, 0)
    return labels.where(F.col("doc_id").isNotNull()).select("doc_id", y.alias("y")).where("y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))


def _training_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.string())
    for batch in batches:
        tokens, heads = [], [[] for _ in HEAD_SHARES]
        for text in batch.column("text"):
            found, words, _ = text_parts(text.as_py())
            tokens.append(list(found))
            counts = head_counts(words)
            for out, share in zip(heads, HEAD_SHARES):
                out.append([h for h, n in counts.items() if n >= share * len(words)])
        columns = [batch.column("y"), pa.array(tokens, kind), *(pa.array(h, kind) for h in heads)]
        yield pa.RecordBatch.from_arrays(columns, names=["y", "tokens", *(f"heads{i}" for i in range(len(HEAD_SHARES)))])


def training_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = TRAIN_DOCS) -> DataFrame:
    """(y, tokens, heads0, heads1) of at most ``most`` labelled documents."""
    chosen = domain_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("y").cast("double").alias("y"), "text")
    schema = "y double, tokens array<string>, " + ", ".join(f"heads{i} array<string>" for i in range(len(HEAD_SHARES)))
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return scratch.stage(labelled.mapInArrow(_training_batches, schema), "training")


def vocabulary(training: DataFrame, column: str, sizes: dict[int, int], most: int = FEATURES) -> list[str]:
    """The ``most`` tokens of greatest G-squared between containing a token and the domain; ``sizes`` has the texts of each domain."""
    total = sum(sizes.values())
    held = training.select("y", F.explode(column).alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("y") == k).alias(f"n{k}") for k in range(len(DOMAINS)))
    ).where("n >= 5")

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    score = F.lit(0.0)
    for k, size in sizes.items():
        here, share = F.col(f"n{k}"), size / total
        score = score + term(here, F.col("n") * share) + term(F.lit(size) - here, (F.lit(total) - F.col("n")) * share)
    best = held.withColumn("g", score).orderBy(F.desc("g"), "token").limit(most)
    return [r["token"] for r in best.select("token").collect()]


class Classifier:
    """The fitted model in the form that tasks apply: sparse presence features, one row of coefficients for each domain."""

    def __init__(self, groups: list[list[str]], coefficients: np.ndarray, intercepts: np.ndarray, found: list[int]) -> None:
        self.index, start = [], 0
        for terms in groups:
            self.index.append({t: start + i for i, t in enumerate(terms)})
            start += len(terms)
        self.coefficients, self.intercepts, self.found = coefficients, intercepts, found

    def features(self, text: str | None) -> tuple[list[int], int]:
        """Indexes of the features that hold and the number of words."""
        tokens, words, n = text_parts(text)
        out = [self.index[0][t] for t in self.index[0].keys() & tokens]
        counts = head_counts(words)
        for index, share in zip(self.index[1:], HEAD_SHARES):
            out += [i for h, i in index.items() if counts[h] >= max(1, share * len(words))]
        return out, n

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n, domains) posteriors in whole parts of UNIT, and the numbers of words."""
        held, words = zip(*(self.features(t.as_py()) for t in texts))
        row = np.repeat(np.arange(len(held)), [len(h) for h in held])
        at = np.concatenate([np.array(h, dtype=np.int64) for h in held])
        logits = np.stack([np.bincount(row, weights=c[at], minlength=len(held)) for c in self.coefficients], axis=1) + self.intercepts
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        p = np.zeros((len(held), len(DOMAINS)), dtype=np.int64)
        p[:, self.found] = np.floor(odds / odds.sum(axis=1, keepdims=True) * UNIT)
        p[np.arange(len(p)), p.argmax(axis=1)] += UNIT - p.sum(axis=1)  # the remainder goes to the first greatest
        return p, np.array(words, dtype=np.int64)


def fitted(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The classifier of ``labels``; without labelled documents all domains are equally likely, with one labelled domain only that one."""
    with Scratch(docs.sparkSession) as scratch:
        training = training_rows(docs, labels, scratch)
        sizes = {int(r["y"]): r["n"] for r in training.groupBy("y").agg(F.count("*").alias("n")).collect()}
        sources = ["tokens", *(f"heads{i}" for i in range(len(HEAD_SHARES)))]
        most = [FEATURES] + [HEAD_FEATURES] * len(HEAD_SHARES)
        groups = [vocabulary(training, c, sizes, n) if len(sizes) > 1 else [] for c, n in zip(sources, most)]
        width = sum(map(len, groups))
        found = sorted(sizes) if sizes else list(range(len(DOMAINS)))
        if not width:
            return Classifier(groups, np.zeros((len(found), 1)), np.zeros(len(found)), found)
        used = [(c, g) for c, g in zip(sources, groups) if g]
        vectors = [CountVectorizerModel.from_vocabulary(g, inputCol=c, outputCol=f"{c}_x").setBinary(True).setMinTF(1.0) for c, g in used]
        seen = training
        for v in vectors:
            seen = v.transform(seen)
        seen = VectorAssembler(inputCols=[v.getOutputCol() for v in vectors], outputCol="x").transform(seen).select("x", "y")
        learn = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-4, maxIter=40, standardization=False)
        model = learn.fit(scratch.stage(seen, "vectors"))
        # classes that no document has lie between those that some have, and get no mass
        return Classifier(groups, model.coefficientMatrix.toArray()[found], model.interceptVector.toArray()[found], found)


def _posterior_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, words = model.value.posteriors(batch.column(batch.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], names=[*batch.schema.names, "n_tokens", *DOMAINS])

    return run


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with n_tokens and the posterior of each domain in parts of UNIT; written and reread."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField(n, T.LongType()) for n in ("n_tokens", *DOMAINS)])
    model = spark.sparkContext.broadcast(fitted(docs, labels))  # some hundreds of terms
    with arrow_batches(spark, BATCH_ROWS):
        return stage(docs.mapInArrow(_posterior_batches(model), schema), "posteriors")


def rate_after(gradients: list[list[float]], max_rate: float) -> Column:
    """The rate of a row with a posterior after the given steps."""
    start = F.lit(float(min(1.0, max_rate)))
    if not gradients:
        return start
    steps = F.array(*(F.array(*map(F.lit, g)) for g in gradients))

    def step(x: Column, g: Column) -> Column:
        push = sum((F.col(d) / F.lit(float(UNIT)) * F.get(g, F.lit(k)) for k, d in enumerate(DOMAINS)), F.lit(0.0))
        return F.least(F.lit(max_rate), F.greatest(F.lit(0.0), x - push))

    return F.aggregate(steps, start, step)


def fit_rates(scored: DataFrame, targets: dict[str, float], max_rate: float) -> list[list[float]]:
    """The steps (gradient times step length, one number a domain) that lead to the rates.

    The targets are shares of a total that leaves the domain of greatest target
    at its present size. Domains without words don't take part.
    """
    with Scratch(scored.sparkSession) as scratch:
        cells = scratch.stage(scored.groupBy(*DOMAINS).agg(F.sum("n_tokens").alias("words")).where("words > 0"), "cells")

        def totals(x: Column) -> list[float]:
            # decimals add up to the same sum in any order
            mass = [(F.col("words") * F.col(d) * F.lit(1.0 / UNIT) * x).cast("decimal(38,9)") for d in DOMAINS]
            row = cells.agg(*(F.sum(m).alias(f"m{k}") for k, m in enumerate(mass))).first()
            return [float(row[f"m{k}"] or 0) for k in range(len(DOMAINS))]

        base = totals(F.lit(1.0))
        lead = max(range(len(DOMAINS)), key=lambda k: targets[DOMAINS[k]])
        whole = base[lead] / targets[DOMAINS[lead]] if targets[DOMAINS[lead]] else 0.0
        goal = [whole * targets[d] for d in DOMAINS]
        gradients: list[list[float]] = []
        previous = None
        for _ in range(STEPS):
            now = totals(rate_after(gradients, max_rate))
            # rows of the weighted Gram matrix sum to at most one, so steps of length one descend
            gradient = [(n - g) / b if b > 0 else 0.0 for n, g, b in zip(now, goal, base)]
            if previous is not None and max(abs(a - b) for a, b in zip(now, previous)) <= TOLERANCE * max(sum(base), 1.0):
                break
            previous = now
            gradients.append(gradient)
        return gradients


def mix_sources(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_rate: float = 1.0) -> DataFrame:
    """All rows and columns of ``docs`` with n_tokens, p_clean, p_toxic, p_junk, rate and copies.

    ``copies`` is the rate rounded: up with the probability of its fraction, by
    a hash of id and text, so that expected totals are those of the rates.
    Null and empty texts have no words and a rate like any other document; long
    texts are read whole; repeated rows, and rows of equal posterior, have equal
    rates; an empty table stays empty. Columns of the new names are replaced,
    all others pass under any name.
    """
    names = ["n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies"]
    carried = Carried(docs, ["doc_id", "text"], names)
    scored = posteriors(carried.df, labels)
    rate = rate_after(fit_rates(scored, targets or TARGETS, max_rate), max_rate)
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rated = scored.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + drawn).cast("int"))
    return carried.back(rated, "n_tokens", *((F.col(d) / float(UNIT)).alias(f"p_{d}") for d in DOMAINS), "rate", "copies")
