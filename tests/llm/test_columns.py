"""Extra columns under every working name of the operators: they pass unchanged and change nothing."""

from collections import Counter
from functools import reduce
from operator import or_

import pytest
from pyspark.sql import functions as F

from tessera.llm.edit_match import contamination
from tessera.llm.interpolated_lm import score_corpus
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.quality import score_documents
from tessera.llm.secret_ledger import Ledger, findings_by_path, scan_new
from tessera.llm.sharding import shard_documents
from tessera.sources.shared import shared_path

#: Names that the operators use inside, now or before.
NAMES = """_offset _bucket _at _jump _doc _row _runs _gone _d _r _uid _print _size _bands _tokens _x _words _p _starts _heads uid print bands tokens
keeper_uid node comp bucket best met leader doc row h keeper pos line slot_bucket slot_at slot_offset slot_n shard_state target raw bin good
blob kind version spans hashes part block clean toxic junk y p item_id distance found_before carried_0 carried_1 Carried_2""".split()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "w0x0 w941x0 w885x0")], "item_id long, text string")


def secrets(docs, *_):
    book = Ledger(shared_path(docs.sparkSession, "ledger"))
    scan_new(docs, book)
    return findings_by_path(docs, book)


OPERATORS = {
    "op1": lambda d, labels, items: shard_documents(d),
    "op2": lambda d, labels, items: dedup_lines(d, 5, 2),
    "op5": lambda d, labels, items: score_documents(d, labels),
    "op6": lambda d, labels, items: near_duplicates(d),
    "op7": secrets,
    "op8": lambda d, labels, items: mix_sources(d, labels),
    "op9": lambda d, labels, items: score_corpus(d, F.lit(0)),
    "op10": lambda d, labels, items: contamination(d, items),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names_do_not_clash(awkward, labels, items, name):
    docs = awkward.select("doc_id", "text").where("doc_id is null or doc_id <> 26")
    wide = docs.withColumns({n: F.concat_ws(":", F.lit(n), "doc_id") for n in NAMES})
    plain, got = (OPERATORS[name](d, labels, items) for d in (docs, wide))
    new = [c for c in plain.columns if c not in ("doc_id", "text")]
    assert Counter(map(str, got.select("doc_id", *new).collect())) == Counter(map(str, plain.select("doc_id", *new).collect()))
    if name != "op9":
        passed = [n for n in NAMES if n not in new]
        assert set(passed) <= set(got.columns)
        wrong = [~F.col(n).eqNullSafe(F.concat_ws(":", F.lit(n), "doc_id")) for n in passed]
        assert got.where(reduce(or_, wrong)).isEmpty()
