"""The text index against a scan, its upkeep, and what its plans read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import text_index
from tessera.operators.text_index import Asked, TextIndex, parsed, says, search_content

ROWS = "id long, text string, at long"
KEYWORDS = ["cat", "cat dog", "dog cat", "ca*", "ca* dog", "cat dog*", "Ünder", "杭州", "foo_bar", "foo_ba cat", "zz9", "cat absent", "bar_foo*", "_ cat", "x"]


def test_parsed():
    assert parsed("cat Dog") == [Asked(("cat",), False), Asked(("dog",), True)]
    assert parsed(" ca* dog ") == [Asked(("ca",), True), Asked(("dog",), False)]
    assert parsed("foo_Bar") == [Asked(("foo", "bar"), True)]
    for keyword in ("", "  ", "a  b", "a-b", "what?", '"a"', "a OR b", "NOT", "a:b", "(a", "**", "a.b"):
        assert parsed(keyword) is None, keyword


def plain(text, asked):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    for one in asked:
        n = len(one.words)
        for i in range(len(words) - n + 1):
            run = words[i : i + n]
            if run[:-1] == list(one.words[:-1]) and (run[-1].startswith(one.words[-1]) if one.prefix else run[-1] == one.words[-1]):
                return True
    return False


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    words = ["cat", "cats", "CAT", "dog", "dogma", "foo", "bar", "foo_bar", "foo-barn", "ünder", "杭州", "zz", "x1", "...", "_"]
    return [(i, " ".join(draw.choices(words, k=draw.randrange(7))), i) for i in range(300)] + [(1000, None, 1), (1001, "", 2), (None, "cat", 3), (1002, "cat " * 50_000, 4)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    out = TextIndex(spark, str(tmp_path_factory.mktemp("index")))
    out.add(spark.createDataFrame(rows, ROWS), "id", "text")
    return out


@pytest.mark.parametrize("keyword", KEYWORDS)
def test_same_as_a_scan(spark, rows, index, keyword):
    df, asked = spark.createDataFrame(rows, ROWS), parsed(keyword)
    want = sorted(i for i, text, _ in rows if i is not None and plain(text, asked))
    assert [r["id"] for r in search_content(df, index, keyword, "id", "text").collect()] == want
    assert sorted(r["id"] for r in df.where(says(F.col("text"), asked)).where("id is not null").collect()) == want


def test_fallback(spark, index):
    df = spark.createDataFrame([(1, "Why NOT? 50%", 5), (2, "why not, ÄH", 7), (3, None, 9), (4, "a\\b", 1)], ROWS)
    ids = lambda keyword: [r["id"] for r in search_content(df, index, keyword, "id", "text", "at").collect()]
    assert (ids(""), ids(" not? "), ids("not_ "), ids("NOT,"), ids("äh!"), ids("a\\b")) == ([2, 1, 4], [1], [], [2], [], [4])
    assert ids("w%t,") == [2]


@pytest.mark.parametrize("chunk", [1 << 14, 7])
def test_upkeep(spark, tmp_path, monkeypatch, chunk):
    """Random batches of new, changed and removed rows, merged now and then, against the rows themselves."""
    monkeypatch.setattr(text_index, "CHUNK", chunk)
    draw, index, state = random.Random(chunk), TextIndex(spark, str(tmp_path)), {}
    assert index.found(parsed("cat")).count() == 0
    for step in range(6):
        ids = draw.sample(range(60), 30)
        if step % 3 == 2:
            index.remove(spark.createDataFrame([(i,) for i in ids[:15]], "id long"), "id")
            for i in ids[:15]:
                state.pop(i, None)
        else:
            new = {i: " ".join(draw.choices(["cat", "cats", "dog", "eel"], k=3)) for i in ids}
            index.add(spark.createDataFrame(list(new.items()), "id long, text string"), "id", "text")
            state.update(new)
        if step == 3:
            index.merge()
            assert len(index.segments()) == 1
        for keyword in ("cat", "cat* eel", "cat dog"):
            assert sorted(r["id"] for r in index.found(parsed(keyword)).collect()) == sorted(i for i, t in state.items() if plain(t, parsed(keyword)))


def test_a_batch_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path))
    index.add(spark.createDataFrame([(1, "cat")], "id long, text string"), "id", "text")
    with monkeypatch.context() as m:
        m.setattr(index, "_publish", lambda segments: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(spark.createDataFrame([(1, "dog")], "id long, text string"), "id", "text")
    assert [r["id"] for r in index.found(parsed("cat")).collect()] == [1] and index.found(parsed("dog")).count() == 0


def test_reads_touched_ranges_only(spark, tmp_path):
    docs = spark.range(4000).select("id", F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 997), F.lit("common")).alias("text"))
    index = TextIndex(spark, str(tmp_path))
    index.add(docs, "id", "text")
    (segment, _), = index.segments()
    ranges = {w: index.ranges(segment, parsed(w)) for w in ("w500", "w5 w7", "common", "nothing*", "w*")}
    assert len(ranges["w500"]) == 1 and len(ranges["common"]) > 1 and len(ranges["w*"]) < 8 and len(ranges["nothing*"]) <= 1 and ranges["w500"] != ranges["common"]
    plan = index.found(parsed("w500"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*range#\d+ = %d" % ranges["w500"][0], plan), plan
    assert index.found(parsed("w500 nothing")).count() == sum(1 for i in range(4000) if i % 997 == 500)


def test_postings_count_a_repeated_row_once():
    """Rows may repeat within and across batches; a word goes on in the next batch."""
    import pyarrow as pa

    from tessera.operators.text_index import _postings

    batches = [[("a", 1), ("a", 1), ("a", 4), ("b", 4)], [("b", 4)], [("b", 4), ("b", 5), ("c", 5), ("c", 5)]]
    rows = [pa.RecordBatch.from_pydict({"word": [w for w, _ in x], "id": [i for _, i in x]}) for x in batches]
    got = [(p["word"], p["first"] + o) for out in _postings(iter(rows)) for p in out.to_pylist() for o in p["offsets"]]
    assert got == [("a", 1), ("a", 4), ("b", 4), ("b", 5), ("c", 5)]
