"""All registered queries of the library, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import catalog, duplicates, expressions, joins, library, merges, reports, scalars, streams, text_search, timeline, tones, upkeep, vectors

MODULES = (timeline, catalog, joins, vectors, duplicates, merges, scalars, reports, tones, streams, library, text_search, upkeep, expressions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
