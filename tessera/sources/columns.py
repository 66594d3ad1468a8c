"""Columns that travel through an operator under names that cannot clash with its own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Carried:
    """``df`` with every column outside ``own`` under a neutral name, and the way back.

    Columns named in ``replaced`` are dropped, since the operator makes columns of these names.
    """

    def __init__(self, df: DataFrame, own: Iterable[str], replaced: Iterable[str] = ()) -> None:
        own, gone = set(own), {c.lower() for c in replaced}
        self.names = [(c, c if c in own else f"carried_{i}") for i, c in enumerate(df.columns) if c.lower() not in gone]
        self.df = df.select(*(F.col(f"`{c}`").alias(n) for c, n in self.names))

    def back(self, out: DataFrame, *new: Column | str, without: Iterable[str] = ()) -> DataFrame:
        """The columns of the input in their order and with their names, then the ``new`` ones."""
        return out.select(*(F.col(n).alias(c) for c, n in self.names if c not in set(without)), *new)
