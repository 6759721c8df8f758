"""Rounding rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(c).cast("long")


def half_up(c: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(c + 0.5).cast("long")
