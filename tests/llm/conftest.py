"""Documents with every awkward case the operators promise to handle."""

import pytest
from llm.cases import WORDS, prose

DOC = "doc_id long, text string, lang string, source string, n_chars long"
@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in all columns, empty and blank texts, a very long one, repeated rows, equal texts and equal ids."""
    rows = [(i, prose(i), "en", "s0", 1) for i in range(12)]
    rows += [(None, prose(3), None, None, None), (None, None, None, None, None), (20, None, "en", "s1", None), (21, "", "en", "s1", 0), (22, " \t\n ", "en", "s1", 4)]
    rows += [(23, prose(23), "en", "s1", 1)] * 3 + [(24, prose(23), "en", "s1", 1), (25, prose(25), "en", "s1", 1), (25, prose(26), "en", "s1", 1)]
    rows += [(26, " ".join(f"long{i % 5000} {WORDS[i % 400]}" for i in range(60_000)), "en", "s2", 1), (27, "ünï çødé 杭州 😀 " * 30, "de", "s2", 1), (-5, "x", "en", "s2", 1)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, 0) for i in range(8)] + [(23, 0, 0), (24, 1, 1), (25, 0, 1), (None, 1, 0), (26, None, None), (3, 1, 0), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
