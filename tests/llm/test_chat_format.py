"""op11 against plain Python, on texts full of marks, and in time on a long conversation."""

import hashlib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm.chat_format import format_conversations, text_under, turns_of

CONV = "conv_id long, turn long, role string, text string"
TOKENS = ["\\", "###", "#", "</turn>", "</turn>\n", "<and/>", "<", "/turn>", "and/>", ": ", ":", " ", "\n", "ü", "😀", "杭", "$1", "### assistant: ", "\\\\", "x"]


def texts_of(rows):
    """Of each conversation its turns in order."""
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)] for c in {r[0] for r in rows}}


def plain(turns):
    """The formatted text and the loss spans of turns."""
    esc = lambda s: re.sub(r"\\|<(?=/turn>|and/>)|#(?=##)", lambda m: m[0] + "\\", s)
    out, spans = "", []
    for role, run in itertools.groupby(turns, key=lambda t: t[0]):
        out += "### " + re.sub(r"\\|<(?=/turn>|and/>)|#(?=##)|:(?= )", lambda m: m[0] + "\\", role) + ": "
        for i, (_, text) in enumerate(run):
            out += "<and/>" if i else ""
            spans += [(len(out), len(out) + len(esc(text)))] if role == "assistant" else []
            out += esc(text)
        out += "</turn>\n"
    return out, spans


@pytest.fixture(scope="module")
def hostile(spark):
    draw = random.Random(7)
    text = lambda n: "".join(draw.choices(TOKENS, k=draw.randrange(n)))
    roles = ["user", "assistant", "assistant", "system", "", None, "a: b", "x:", "###", "</turn>\n", "\\"]
    rows = [(c, t, draw.choice(roles), text(30)) for c in range(60) for t in range(draw.randrange(1, 9))]
    rows += [(None, None, None, None), (None, 1, "assistant", None), (None, None, "user", ""), (100, 0, "assistant", ""), (101, 3, "user", "same"), (101, 3, "user", "same"), (101, 3, "assistant", "same")]
    return rows, spark.createDataFrame(rows, CONV)


def test_format(hostile):
    rows, df = hostile
    got = {r["conv_id"]: r for r in format_conversations(df.withColumns({n: F.lit("clash") for n in ("turns", "out", "formatted", "loss")})).collect()}
    want = texts_of(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert (got[conv]["formatted"], [tuple(s) for s in got[conv]["loss_spans"]]) == plain(turns)


def test_round_trip(hostile):
    rows, df = hostile
    out = format_conversations(df).select("conv_id", "formatted", turns_of(F.col("formatted")).alias("t"), text_under(F.col("formatted"), F.col("loss_spans")).alias("l"))
    for r in out.collect():
        turns = texts_of(rows)[r["conv_id"]]
        assert [tuple(t) for t in r["t"]] == turns
        assert r["l"] == [text for role, text in turns if role == "assistant"]
        *blocks, rest = r["formatted"].split("</turn>\n")
        assert rest == "" and all(b.startswith("### ") for b in blocks)
        assert not any(re.search("###|</turn>", part) for b in blocks for part in b[4:].split("<and/>"))


def test_empty(spark):
    assert format_conversations(spark.createDataFrame([], CONV)).collect() == []


def test_long_conversation_and_long_texts(spark):
    """20 000 turns, and one text of 4 MB: nothing grows with the square of the length."""
    long = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</turn> ü 😀 \\ "), F.col("id")).alias("text"))
    one = spark.range(1).select(F.lit(2).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("<and/>ü\\ ### "), 330_000).alias("text"))
    start = time.perf_counter()
    out = format_conversations(long.union(one))
    rows = out.select("conv_id", F.size(turns_of(F.col("formatted"))).alias("n"), F.sha2(F.array_join(text_under(F.col("formatted"), F.col("loss_spans")), ""), 256).alias("d")).collect()
    assert time.perf_counter() - start < 40
    loss = {1: "".join(f"</turn> ü 😀 \\ {i}" for i in range(20_000) if i % 3), 2: "<and/>ü\\ ### " * 330_000}
    assert {r["conv_id"]: (r["n"], r["d"]) for r in rows} == {c: (20_000 if c == 1 else 1, hashlib.sha256(t.encode()).hexdigest()) for c, t in loss.items()}
