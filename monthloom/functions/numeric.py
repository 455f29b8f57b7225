"""Rounding rules and small array arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_count(value: Column) -> Column:
    """A forecast as a count: rounded half to even, never below zero; a missing forecast stays NULL."""
    count = F.greatest(F.lit(0).cast("bigint"), F.bround(value, 0).cast("bigint"))
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), count)


def two_decimals(value: Column) -> Column:
    return F.round(value, 2)


def display_whole(value: Column) -> Column:
    """Whole units for display, halves rounded up."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def dot(left: Column, right: Column) -> Column:
    """Inner product of two equally long arrays of doubles."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
