"""Helpers for building larger expressions out of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    The optimizer may inline a projected column into a lambda that mentions it
    once, which would evaluate it again for every array element. A lambda
    variable is never inlined, and it is evaluated only if its branch of a
    CASE is taken.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_present(values: Column) -> Column:
    """First non-null element of an array, or NULL."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def last_present(values: Column) -> Column:
    """Last non-null element of an array, or NULL."""
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))


def blank_to_null(value: Column) -> Column:
    # Not nullif: in a branch or a lambda the optimizer writes its value out twice.
    return let(value, lambda v: F.when(v != "", v))


def position_of(values: Column, wanted: Column | str) -> Column:
    """1-based INT position of the first equal element, NULL when absent."""
    return let(F.array_position(values, wanted), lambda at: F.when(at > 0, at)).cast("int")


def first_match(text: Column, pattern: str) -> Column:
    """First match of a pattern that is not empty, else NULL; searched once."""
    return blank_to_null(F.regexp_extract(text, pattern, 0))


def positions(size: Column) -> Column:
    """Array 0 .. size-1, empty for size 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>")
    )
