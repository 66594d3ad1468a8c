"""op13 against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical as module
from tessera.llm.lexical import added, best, ranked_documents, sliced

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def brute(docs, items, most):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in set(items):
        scores = []
        for doc, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            scores += [(-score, doc is None, doc or 0)] if score > 0 else []
        out.update((item, i + 1, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(scores)[:most]))
    return out


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(5)
    vocabulary = [f"w{min(int(draw.paretovariate(0.7)), 400)}" for _ in range(3000)]
    docs = [(i * 7 % 1009, " ".join(draw.choices(vocabulary, k=draw.randrange(80)))) for i in range(900)]
    docs += [(2000 + i, "copied words of a group w1") for i in range(60)] + docs[:5] + [(None, "copied words"), (None, None), (5000, None), (5001, ""), (5002, "-- ??"), (5003, "Ünder 杭州 A1b2 " * 9), (5004, "w1 w2 " * 40_000), (-3, "copied")]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(1, 40)))) for i in range(150)]
    items += [(200, "copied group"), (201, "copied copied COPIED words"), (202, None), (203, ""), (204, "absent"), (205, "ünder Ünder a1b2 杭州"), (None, "copied w1"), items[3], (206, "w1"), (206, "w2"), (207, "w1 w2 w3 " * 700)]
    return docs, items


@pytest.mark.parametrize("cells, documents, block", [(1 << 23, 8192, 4 << 20), (2000, 100, 3000)])
def test_against_brute_force(spark, tables, monkeypatch, cells, documents, block):
    """With one bitmap a task, and with many batches, bitmaps and blocks of queries."""
    for name, value in (("CELLS", cells), ("DOCUMENTS", documents), ("BLOCK", block)):
        monkeypatch.setattr(module, name, value)
    docs, items = tables
    clash = {n: F.lit("clash") for n in ("n", "ids", "tfs", "score", "rank", "no")}
    got = ranked_documents(spark.createDataFrame(docs, DOC).withColumns(clash), spark.createDataFrame(items, ITEM).withColumns(clash), 20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in got.where("item_id is null or item_id <> 206").collect()]
    assert Counter(rows) == brute(docs, [i for i in items if i[0] != 206], 20)
    twice = [tuple(r) for r in got.where("item_id = 206").collect()]
    assert Counter(twice) == brute(docs, [(206, "w1")], 20) + brute(docs, [(206, "w2")], 20)


def test_ids_of_other_types_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "cat dog"), ("a", "cat dog"), ("c", "cat"), ("d", "fish")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "cat dog")], "item_id string, text string")
    assert [(r["doc_id"], r["rank"]) for r in ranked_documents(docs, items, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert ranked_documents(docs.limit(0), items).collect() == [] == ranked_documents(docs, items.limit(0)).collect()


def test_slices_add_and_rank():
    """Sums and best places of random impacts, ties and zeros among them."""
    draw = np.random.default_rng(2)
    for places in (1, 64, 130, 1000):
        impacts = draw.integers(0, 1 << int(draw.integers(1, 35)), (12, places)) * (draw.random((12, places)) < 0.3)
        terms, at = np.nonzero(impacts)
        slices = sliced(terms, at, impacts[terms, at], 12, places)
        if not len(slices):
            continue
        queries = sorted((draw.integers(0, 12, draw.integers(1, 9)) for _ in range(10)), key=len, reverse=True)
        sums = added(slices, queries)
        sure, tied = best(sums, 20)
        for i, q in enumerate(queries):
            want = impacts[q].sum(axis=0)
            got = sum(np.unpackbits(s[i].view(np.uint8), bitorder="little").astype(np.int64) << b for b, s in enumerate(sums))
            assert (got[:places] == want).all() and not got[places:].any()
            order = [p for p in np.lexsort((np.arange(places), -want)) if want[p]][:20]
            found = list(module._places(sure[i]))
            assert sorted([*found, *module._places(tied[i])[: 20 - len(found)]]) == sorted(order)
