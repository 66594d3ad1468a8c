"""Listing of photo rows: optional predicates, keyword and token search, paging."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.text_index import like_any_case, parsed, says


@dataclass(frozen=True)
class SmartFilter:
    """Predicates of a smart search; those left out don't apply."""

    keyword: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    location: str | None = None
    category: str | None = None
    tone: str | None = None
    label: str | None = None
    person_id: str | None = None


def contains_any_case(column: Column, text: str) -> Column:
    """Substring match regardless of case; % and _ in ``text`` are wildcards, as the application has them."""
    return column.ilike(f"%{text}%")


def smart_filter(photos: DataFrame, f: SmartFilter, keyword_columns: list[str]) -> DataFrame:
    """Rows that meet all given predicates; the end date includes its whole day. Blank texts don't apply."""
    f = replace(f, **{n: v for n, v in ((n, (v or "").strip() or None) for n, v in asdict(f).items())})
    tests: list[Column] = []
    if f.keyword:
        tests.append(reduce(lambda a, b: a | b, (contains_any_case(F.col(c), f.keyword) for c in keyword_columns)))
    if f.date_from:
        tests.append(F.col("shoot_time") >= f.date_from)
    if f.date_to:
        tests.append(F.col("shoot_time") <= f"{f.date_to} 23:59:59")
    if f.location:
        tests.append(contains_any_case(F.col("location"), f.location))
    if f.category:
        tests.append(F.col("category") == f.category)
    for column, text in (("label", f.label), ("person_ids", f.person_id)):
        if text:
            tests.append(contains_any_case(F.col(column), text))
    if f.tone:
        tests.append(F.col("tone") == f.tone)
    return photos.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def newest_first(time: str = "shoot_time", key: str = "id") -> list[Column]:
    """The order of search results: rows without a time last, the newest first, the greatest key on ties."""
    return [F.col(time).desc_nulls_last(), F.col(key).desc()]


def range_filter(rows: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows within all numeric bounds; a bound of None is none. Only given bounds enter the plan."""
    for column, (low, high) in bounds.items():
        if low is not None:
            rows = rows.where(F.col(column) >= low)
        if high is not None:
            rows = rows.where(F.col(column) <= high)
    return rows


def token_search(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows with one of the words of ``query``; the last word may be a beginning. A query that is no search for words finds rows LIKE it."""
    asked = parsed(query)
    return rows.where(like_any_case(F.col(column), query) if asked is None else says(F.col(column), asked))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1 of ``size`` rows; a size below 1 means all."""
    ordered = rows.orderBy(*order)
    return ordered if size < 1 else ordered.offset((max(number, 1) - 1) * size).limit(size)


def month_slice(rows: DataFrame, year: str, month: str) -> DataFrame:
    """Rows of one month; empty ``year``: rows without a time; empty ``month``: rows with a year only."""
    t = F.col("shoot_time")
    if not year:
        return rows.where(t.isNull() | (t == ""))
    test = F.substring(t, 1, 4) == year
    return rows.where(test & (F.substring(t, 6, 2) == month if month else F.char_length(t) < 7))


def in_given_order(keys: list[str], rows: DataFrame, column: str) -> DataFrame:
    """One row for each key in its order, with nulls where ``rows`` has none; the key list is the caller's own and small."""
    listed = rows.sparkSession.createDataFrame(list(enumerate(keys)), f"_place int, {column} string")
    return listed.join(rows, column, "left").orderBy("_place")
