"""Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(x: str) -> str:
    """SQL of a value brought into 0..1. Formulas are text: an expression of many terms is a single call."""
    return f"greatest(0D, least(1D, {x}))"


def average(xs: list[str]) -> str:
    """SQL of the mean of columns or expressions that lie in 0..1."""
    return f"(({' + '.join(xs)}) / {len(xs)}D)"


def total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def evenness(xs: list[Column], average: Column | None = None) -> tuple[Column, Column]:
    """(smallest value, 1 - population standard deviation) across columns; average: a column that holds their mean already."""
    average = total(xs) / len(xs) if average is None else average
    return F.least(*xs), 1 - F.sqrt(total([(x - average) * (x - average) for x in xs]) / len(xs))


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that depends on the key alone: no partitioning or retry changes it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])), 1, 8), 16, 10).cast("long") / 4294967296.0


def places(x: Column, digits: int) -> Column:
    """A number from 0 to under 1000 as text with so many places, rounded from its exact value, ties to even, as C's printf does."""
    return F.format_number(x, digits)


def tidy(x: Column | str, digits: int) -> Column:
    """A value from 0 up, rounded; halves go up even if the last bits, in which sums of another order differ, say otherwise."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 10.0 ** -(digits + 4), digits)
