"""The corpus queries that SQL can express against DuckDB, on two sizes."""

import pytest
from compare import assert_same, connection

from tessera.llm import registry


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name, sf):
    base = f"/root/testdata/{sf}"
    assert_same(registry.queries()[name](spark, base), connection(base), registry.oracle_sql()[name])


def test_names():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
