"""Exact order statistics of a column of any length, without gathering it."""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of one pass; their counts are what reaches the driver.
BINS = 4096
#: As many values as this are fetched and sorted at once.
FEW = 4096


class Span(NamedTuple):
    """Values from ``low`` to ``high``: how many, and how many are below them."""

    low: float
    high: float
    n: int
    before: int


def _numbers(df: DataFrame, column: str) -> DataFrame:
    """(v): the values that are numbers."""
    return df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(column).cast("double").alias("v"))


def _whole(rows: DataFrame) -> Span | None:
    r = rows.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    return Span(r["low"], r["high"], r["n"], 0) if r["n"] else None


def _bin(span: Span) -> Column:
    width = (span.high - span.low) / BINS
    if width > 0 and math.isfinite(width):
        return F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.lit(span.low)) / F.lit(width)))
    return (F.col("v") > F.lit(span.low)).cast("long")


def _found(rows: DataFrame, whole: Span, places: list[int]) -> dict[int, float]:
    """The values at 0-based places of the sorted (v).

    Each pass counts values in bins of the spans that hold a place and goes on with the bins that do, for all places at
    once, until a span has one value or few rows, which are fetched. Values thin out by the number of bins, so two or
    three passes do; nothing is sorted, and a value of very many rows is one bin.
    """
    found: dict[int, float] = {}
    spans = {whole}
    while spans:
        inside = lambda s: F.col("v").between(s.low, s.high)
        held = {s: [p for p in places if s.before <= p < s.before + s.n] for s in spans}
        small = [s for s in spans if held[s] and s.low < s.high and s.n <= FEW]
        large = [s for s in spans if held[s] and s.low < s.high and s.n > FEW]
        for s in spans:
            if s.low == s.high:
                found |= {p: s.low for p in held[s]}
        if small:
            values = sorted(r["v"] for r in rows.where(reduce(or_, map(inside, small))).collect())
            for s in small:
                own = values[bisect_left(values, s.low) :]
                found |= {p: own[p - s.before] for p in held[s]}
        spans = set()
        if large:
            named = F.coalesce(*(F.when(inside(s), F.struct(F.lit(i).alias("span"), _bin(s).alias("bin"))) for i, s in enumerate(large)))
            bins = rows.where(reduce(or_, map(inside, large))).groupBy(named.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).select("b.span", "n", "low", "high")
            before = {i: s.before for i, s in enumerate(large)}
            for r in sorted(bins.collect(), key=lambda r: (r["span"], r["low"])):
                span = Span(r["low"], r["high"], r["n"], before[r["span"]])
                before[r["span"]] += r["n"]
                if any(span.before <= p < span.before + span.n for p in places):
                    spans.add(span)
    return found


def values_at(df: DataFrame, column: str, places: list[int]) -> list[float]:
    """The values at the given 0-based places of the sorted column; nulls and NaN don't count."""
    rows = _numbers(df, column)
    whole = _whole(rows)
    found = _found(rows, whole, places) if whole else {}
    return [found[p] for p in places]


def median_and_peak(df: DataFrame, column: str) -> tuple[float, float | None]:
    """The exact median, the mean of the middle two for an even number, and the greatest value; 0 and None for an empty column."""
    rows = _numbers(df, column)
    whole = _whole(rows)
    if whole is None:
        return 0.0, None
    a, b = (whole.n - 1) // 2, whole.n // 2
    found = _found(rows, whole, [a, b])
    return (found[a] + found[b]) / 2, whole.high


def median(df: DataFrame, column: str) -> float:
    """Exact median, the mean of the middle two for an even number; 0 for an empty column."""
    return median_and_peak(df, column)[0]


def nearest_rank(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Percentiles by nearest rank: the value at round((n - 1) q), halves away from zero; 0 for an empty column."""
    rows = _numbers(df, column)
    whole = _whole(rows)
    if whole is None:
        return [0.0] * len(shares)
    places = [int((whole.n - 1) * q + 0.5) for q in shares]
    found = _found(rows, whole, places)
    return [found[p] for p in places]
