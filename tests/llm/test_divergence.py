"""op12 against plain Python in unbounded integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence as module
from tessera.llm.divergence import scaled, source_divergence

DOC = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs, most):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(r[2] or "", r[3] or "", Counter(words(r[1]))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = sorted((t for t, n in df.items() if n >= min_docs), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, found in own:
            counts[source].update({t: found[t] for t in kept})
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        probs, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pair = [(-sum(f(probs[s][t], probs[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            term = [(-f(probs[s][t], q[t]), t.encode()) for t in kept if counts[s][t] > 0 and probs[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:most])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(items)]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    vocabulary = [*(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)), "Über", "über", "杭州", "ﬀ", "😀", "\uffee", "É"]
    made = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(60))) + draw.choice(["", "1-2", " A_b"]), draw.choice(["en", "de", None, ""]), draw.choice(["s1", "s2", "s10", "ü", None, "s1 "])) for i in range(400)]
    return [*made, *made[:20], (None, None, None, None), (1, "", "xx", "alone"), (2, "tie tie", "yy", "a"), (3, "tie tie", "yy", "b"), (4, None, "yy", "c"), (5, "long words " * 30_000, "en", "s1")]


@pytest.mark.parametrize("cells", [1 << 19, 48])
def test_against_brute_force(spark, rows, monkeypatch, cells):
    """One chunk a language, and many."""
    monkeypatch.setattr(module, "CELLS", cells)
    df = spark.createDataFrame(rows, DOC).withColumns({n: F.lit("clash") for n in ("term", "n", "id", "chunk", "counts", "groups", "v", "item", "rank", "part", "value")})
    got = source_divergence(df, 10, 10)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 10, 10)


def test_flushed_batches(spark, rows, monkeypatch):
    monkeypatch.setattr(module, "HELD", 5)
    assert Counter(tuple(r) for r in source_divergence(spark.createDataFrame(rows, DOC), 2, 3).collect()) == brute(rows, 2, 3)


def test_nothing_kept_and_empty(spark):
    rows = [(1, "a b", "en", "x"), (2, "b c", "en", "y"), (3, "d", "de", "x")]
    assert Counter(tuple(r) for r in source_divergence(spark.createDataFrame(rows, DOC)).collect()) == brute(rows, 10, 10) == Counter([("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)])
    assert source_divergence(spark.createDataFrame([], DOC)).collect() == []


def test_scaled_is_exact():
    draw = random.Random(1)
    for _ in range(2000):
        v, total = draw.randrange(1, 10**9), draw.randrange(10 ** draw.randrange(1, 16))
        c = draw.randrange(total + 1)
        assert scaled(np.array([c]), total, v)[0] == 1 + 10**9 * (c + 2) // (total + 2 * v)
