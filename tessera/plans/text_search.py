"""Searches by the text index, each after the index was built and kept up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.text_index import TextIndex, search_content
from tessera.sources.shared import shared_path
from tessera.sources.tables import table


def _kept_up(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TextIndex]:
    """Documents after a batch of changed texts and one of removed rows, and their index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    index = TextIndex(spark, shared_path(spark, "text-index"))
    index.add(docs, "doc_id", "text")
    changed = docs.where("doc_id % 5 = 0").withColumn("text", F.concat_ws(" ", "source", "lang"))
    index.add(changed, "doc_id", "text")
    index.remove(docs.where("doc_id % 7 = 0"), "doc_id")
    return docs.where("doc_id % 5 <> 0").unionByName(changed).where("doc_id % 7 <> 0"), index


def text_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the word thnd or src7 or one that begins with ñdo."""
    rows, index = _kept_up(spark, sf_dir)
    return search_content(rows, index, "thnd SRC7 ñdo", "doc_id", "text").select("doc_id", "lang", F.char_length("text").alias("chars"))


def text_index_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged index gives the same as one of several segments; stars ask for beginnings of several words."""
    rows, index = _kept_up(spark, sf_dir)
    index.merge()
    return search_content(rows, index, "src1* thnd*", "doc_id", "text").select("doc_id", "lang")


def text_index_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs that are no search for words: rows LIKE the keyword."""
    rows, index = _kept_up(spark, sf_dir)
    return search_content(rows, index, " tH. ", "doc_id", "text").select("doc_id", "source")


QUERIES = {f.__name__: f for f in (text_index_search, text_index_merged, text_index_fallback)}

_STATE = """s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat_ws(' ', source, lang) ELSE text END AS text, lang, source FROM documents WHERE doc_id % 7 <> 0)"""
_WORDS = r"regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')"
ORACLES = {
    "text_index_search": f"WITH {_STATE} SELECT doc_id, lang, length(text)::INT AS chars FROM s WHERE len(list_filter({_WORDS}, lambda w: w IN ('thnd', 'src7') OR starts_with(w, 'ñdo'))) > 0",
    "text_index_merged": f"WITH {_STATE} SELECT doc_id, lang FROM s WHERE len(list_filter({_WORDS}, lambda w: starts_with(w, 'src1') OR starts_with(w, 'thnd'))) > 0",
    "text_index_fallback": f"WITH {_STATE} SELECT doc_id, source FROM s WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'th.')",
}
