"""Query op3: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.line_blocks import extract_pages
from tessera.sources.tables import table


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLES: dict[str, str] = {}
