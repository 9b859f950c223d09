"""Columns that hold sets, their signatures, and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<int>"


def canonical(values: Column) -> Column:
    """Distinct values in order; null becomes the empty set."""
    return F.coalesce(F.array_sort(F.array_distinct(values)), F.array().cast(EMPTY))


def gathered(values: Column) -> Column:
    """Aggregate: the set of a group's values, in order."""
    return F.array_sort(F.collect_set(values))


def signature(values: Column, empty: str = "0") -> Column:
    """Members in numeric order, joined; a sentinel for the empty set."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.array_join(F.array_sort(values), ","))


def count_of(values: Column) -> Column:
    return F.greatest(F.coalesce(F.size(values), F.lit(0)), F.lit(0))


def parsed(text: Column, separator: str = ",") -> Column:
    """Integers of a joined text; parts that are no integers go."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, infinite where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(float("inf")))


def fraction(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part, whole)


def divided(part: Column, whole: Column) -> Column:
    """part / whole as IEEE has it: where whole is 0, infinite, or NaN of 0, and never an error."""
    part = part.cast("double")
    endless = F.when(F.isnan(part) | (part == 0), float("nan")).when(part > 0, float("inf")).when(part < 0, float("-inf"))
    return F.when(whole == 0, endless).otherwise(F.try_divide(part, whole))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
