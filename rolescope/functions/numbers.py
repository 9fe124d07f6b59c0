"""Percentages and rounding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as DECIMAL(5,2), half-up; NULL when the whole is zero."""
    return (F.lit(Decimal("100.0")) * part / F.nullif(whole, F.lit(0).cast("bigint"))).cast("decimal(5,2)")


def pct_even(part: Column, whole: Column, places: int) -> Column:
    """``100 * part / whole`` as a double, rounded half-even the way numpy rounds."""
    return round_even(F.lit(100.0) * part / F.nullif(whole, F.lit(0).cast("bigint")), places)


def round_even(x: Column, places: int) -> Column:
    # numpy scales, rounds to the nearest even integer and scales back; bround() works on
    # the printed decimal instead and differs on values such as 2.675
    scale = F.lit(float(10**places))
    return F.rint(x * scale) / scale


def pct_text(part: Column, whole: Column) -> Column:
    """A percentage as text with two decimals and a percent sign."""
    return F.format_string("%.2f%%", pct_even(part, whole, 2))
