"""Sums whose result does not depend on the order in which tasks finish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def money_sum(value: Column) -> Column:
    """Exact total of an amount, as a double.

    Amounts count to four decimals, finer ones are rounded to that; a total beyond
    eighteen digits raises under ANSI.
    """
    return F.sum(value.cast(MONEY)).cast("double")


def money_avg(value: Column) -> Column:
    """Mean of an amount from its exact total."""
    return money_sum(value) / F.count(value)


def slope(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> Column:
    """Least-squares slope from sums; NULL when all x are equal."""
    return (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))


def intercept(n: Column, sx: Column, sy: Column, b: Column) -> Column:
    return (sy - b * sx) / n
