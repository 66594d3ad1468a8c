"""op10: Myers against the edit table, planted passages with errors."""

import random

import pytest
from llm.cases import clashing, prose

from tessera.llm.edit_match import Matcher, Myers, contamination, pieces, plain
from tessera.llm.op10_query import op10_decontamination


def table_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i in range(1, len(pattern) + 1):
        new = [i]
        for j in range(1, len(text) + 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (pattern[i - 1] != text[j - 1])))
        row = new
    return min(row)


def test_myers():
    r = random.Random(3)
    for _ in range(500):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(a, 14))) for a in (1, 0))
        assert Myers(p).least(t) == table_distance(p, t)


def test_pieces_cover_the_passage():
    cut = pieces("abcdefghij", 3)
    assert "".join(p for _, p in cut) == "abcdefghij" and len(cut) == 4 and all(p for _, p in cut)


def mutated(r, text, edits):
    chars = list(text)
    for _ in range(edits):
        at, kind = r.randrange(len(chars)), r.randrange(3)
        chars[at : at + 1] = {0: ["q"], 1: [], 2: [chars[at], "q"]}[kind]
    return "".join(chars)


def test_everything_within_the_budget_is_found():
    r = random.Random(9)
    item = plain(prose(5, 40))
    budget = int(len(item) * 0.08)
    matcher = Matcher([(7, item)], 0.08)
    for trial in range(60):
        edits = r.randint(0, 2 * budget)
        text = prose(trial + 50, 30) + " " + mutated(r, item, edits) + " " + prose(trial + 90, 30)
        best = table_distance(item, plain(text))
        assert matcher.find(text) == ([(7, best)] if best <= budget else [])


def test_query_finds_planted_errors(spark):
    """Through the operator: items with 0 to twice the budget of errors in documents, ids that are text, against the edit table."""
    r = random.Random(11)
    items = [(f"item {i}", prose(i * 7 + 1, 12)) for i in range(6)]
    docs = [(d, f"{prose(d + 500, 15)} {mutated(r, plain(text), r.randint(0, 2 * int(len(plain(text)) * 0.08)))} {prose(d + 900, 15)}") for d in range(30) for _, text in [items[d % 6]]]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), 0.08)
    want = {}
    for d, text in docs:
        near = {i: (table_distance(plain(t), plain(text)), int(len(plain(t)) * 0.08)) for i, t in items}
        want[d] = {i: n for i, (n, budget) in near.items() if n <= budget}
    assert {x["doc_id"]: {f["item_id"]: f["distance"] for f in x["found"]} for x in got.collect()} == want
    assert len({n for found in want.values() for n in found.values()}) > 4 and not all(want.values())


def test_scripts_without_spaces_and_short_items(spark):
    items = spark.createDataFrame([(1, "北京是中国的首都和最大的城市之一"), (2, "ภาษาไทยมีพยัญชนะ"), (3, "unfathomable quagmire"), (4, "東京都港区六本木"), (5, "a b c"), (6, "…")], "item_id long, text string")
    docs = [(1, "据说北京是中国的首都和最大的城市之一，人口众多"), (2, "据说北京是中国的首部和最大的城市之一。"), (3, "คือภาษาไทยมีพยัญชนะมาก"), (4, "An UNFATHOMABLE, quagmire."), (5, "住所は東京都港区六本木です"), (6, "a b c"), (7, "北京是城市")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {r["doc_id"]: [(f["item_id"], f["distance"]) for f in r["found"]] for r in got} == {1: [(1, 0)], 2: [(1, 1)], 3: [(2, 0)], 4: [(3, 0)], 5: [(4, 0)], 6: [], 7: []}


def test_short_passages_match_whole_words():
    matcher = Matcher([(1, "cat"), (2, "!!!"), (3, "")], 0.08)
    assert matcher.find("A Cat.") == [(1, 0)] and matcher.find("concatenate") == [] and matcher.find("") == [] and matcher.find(None) == []


@pytest.mark.parametrize("block", [50, 10**6])
def test_awkward_rows(spark, awkward, empty, monkeypatch, block):
    monkeypatch.setattr("tessera.llm.edit_match.BLOCK_CHARS", block)
    items = spark.createDataFrame([(1, prose(3, 30).upper()), (1, prose(3, 29)), (2, prose(300, 30)), (None, prose(4, 9)), (3, None), (4, prose(23, 40))], "item_id long, text string")
    want = {1: {3, None}, 4: {23, 24}}
    for docs in (awkward, clashing(awkward, ["found", "n_items", "contaminated", "item_id"])):
        rows = contamination(docs, items).collect()
        assert len(rows) == awkward.count()
        for item, ids in want.items():
            hit = {r["doc_id"] for r in rows if item in [f["item_id"] for f in r["found"]]}
            assert hit == ids
        assert all(r["contaminated"] == (r["n_items"] > 0) and len({f["item_id"] for f in r["found"]}) == r["n_items"] for r in rows)
    assert contamination(empty, items).count() == 0
    assert contamination(awkward, items.limit(0)).where("contaminated").count() == 0


def test_query(spark, sf_dir):
    """The generated documents hold whole passages, so brute force is a substring test."""
    docs = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    rows = op10_decontamination(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r["contaminated"] for r in rows)
    for r in rows:
        exact = {i for i, d in zip(r["item_ids"], r["distances"]) if d == 0}
        assert exact == {i for i, t in items.items() if t in docs[r["doc_id"]]}
