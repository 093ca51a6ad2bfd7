"""Passes over arrays and long texts within a row, in time that grows with their length.

A fold that adds to an array copies it at each step.  These work in blocks instead, of
``BLOCK`` elements of an array or ``SIZE`` characters of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of an array, and characters of a piece of a text.
BLOCK, SIZE = 256, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The fold of what precedes each element of an array, and of all of it behind the last.

    ``step`` must be associative and ``first`` neutral.
    """

    def fold(block: Column) -> Column:
        return F.aggregate(block, F.array(first), lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x)))

    def of(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values) + 1, F.lit(BLOCK))
        sums = F.transform(starts, lambda at: F.aggregate(F.slice(values, at, BLOCK), first, step))
        # A block gives what precedes each of its elements; the last one is never full and gives the whole too.
        inside = lambda bases: F.transform(starts, lambda at, i: F.transform(fold(F.slice(values, at, BLOCK - 1)), lambda x: step(F.get(bases, i), x)))
        return F.flatten(let(fold(sums), inside))

    return let(values, of)


def cut(values: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """An array in runs: a run begins at its first element and wherever ``begins(values, index)`` holds."""

    def of(values: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | begins(values, i))

        def slices(starts: Column) -> Column:
            return F.transform(starts, lambda at, n: F.slice(values, at + 1, F.coalesce(F.get(starts, n + 1), F.size(values)) - at))

        return let(starts, slices)

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.transform(v, lambda x: F.array(x))))


def pieces(text: Column) -> Column:
    """A text in pieces of ``SIZE`` characters."""
    return F.when(F.length(text) <= SIZE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SIZE}}}"), F.lit(0)))


def window(parts: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to before ``end`` of a text in ``pieces``, in time that grows with what is asked for."""
    first = F.floor(start / SIZE).cast("int")
    held = F.array_join(F.slice(parts, first + 1, F.floor(end / SIZE).cast("int") - first + 1), "")
    return F.substring(held, start - first * SIZE + 1, end - start)
