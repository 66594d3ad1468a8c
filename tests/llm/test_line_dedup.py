"""op2 against brute force and DuckDB."""

import hashlib
import time
from collections import defaultdict

from compare import assert_same, connection
from llm.cases import clashing
from pyspark.sql import functions as F

from tessera.llm.line_dedup import dedup_lines
from tessera.llm.op2_query import ORACLES, op2_line_dedup

LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)

    def rank(i):
        return (0, 0) if i is None else (1, i)

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and rank(i) < max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    out = dedup_lines(df, 40, 5).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("h"))
    return sorted(map(tuple, out.collect()), key=str)


SHARED = "This line of more than forty characters is shared by many."


def test_rules(spark, empty):
    rows = [(i, f"own line {i}\n{SHARED}\n{SHARED.upper()} \nshort\nshort\n") for i in range(6)]
    rows += [(None, SHARED), (None, f"{SHARED}\n\n"), (5, SHARED), (7, None), (8, ""), (9, "\n"), (10, "É" * 39), (3, rows[3][1])]
    rows += [(i, "exactly in four documents, so it must stay here") for i in range(20, 24)]
    rows += [(i, "\x0b" + "é" * 40 + "\r") for i in range(30, 35)] + [(35, "É" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute(rows)
    assert run(clashing(df, ["n_lines", "h", "doc", "row", "line"])) == brute(rows)
    assert run(empty) == []


def test_bitmap(spark):
    rows = [(i, "\n".join([SHARED, SHARED, "kept", SHARED])) for i in range(5)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first()
    assert [tuple(r) for r in out["dropped_runs"]] == [(0, 2), (3, 1)]
    assert out["kept_text"] == "kept"


def test_awkward_rows(awkward):
    assert run(awkward) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_query(spark, sf_dir):
    assert_same(op2_line_dedup(spark, sf_dir), connection(sf_dir), ORACLES["op2_line_dedup"])


def test_one_very_long_text(spark):
    """200 000 lines, every other one shared by five documents: time grows with the lines, not with their square."""
    text = "\n".join(f"own {i}" if i % 2 else f"{SHARED}{i}" for i in range(200_000))
    docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    start = time.perf_counter()
    rows = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.md5("kept_text").alias("kept")).collect()}
    assert time.perf_counter() - start < 60
    kept = hashlib.md5("\n".join(f"own {i}" for i in range(1, 200_000, 2)).encode()).hexdigest()
    assert all(rows[i] == (200_000, 100_000, kept) for i in range(4)) and rows[4][:2] == (200_000, 0)
