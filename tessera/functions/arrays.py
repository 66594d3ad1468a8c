"""Array expressions that stay linear, or nearly so, in the length of one array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    A column named inside a lambda is computed again for each element, since Catalyst inlines the
    projection that made it. A lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def positions(array: Column) -> Column:
    """0, 1, ... to the last index of an array; empty for an empty one."""
    return F.filter(F.sequence(F.lit(0), F.size(array)), lambda i: i < F.size(array))


def _sums(values: Column) -> Column:
    """0 and the sums of the first 1, 2, ... values, by a fold that copies what it has: for short arrays."""
    return F.aggregate(values, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running_totals(values: Column) -> Column:
    """0 and the sums of the first 1, 2, ... values of an array of longs; its last element is the total.

    The array is cut into about as many pieces as each has values, so the copying of the folds
    grows with the power 1.5 of the length, not with its square.
    """

    def over(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return let(width, lambda w: let(F.transform(F.sequence(F.lit(0), F.size(v).cast("int"), w), lambda at: _sums(F.slice(v, at + 1, w))), joined))

    def joined(parts: Column) -> Column:
        bases = _sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        moved = let(bases, lambda b: F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(p, 2, F.size(p)), lambda x: x + F.get(b, k)))))
        return F.concat(F.array(F.lit(0).cast("bigint")), moved)

    return let(values, over)
