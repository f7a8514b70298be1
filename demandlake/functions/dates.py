"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sunday_on_or_after(day: Column) -> Column:
    return F.date_add(day, (8 - F.dayofweek(day)) % 7)


def month_ends_after(day: Column, periods: int) -> Column:
    """The next ``periods`` month ends strictly after ``day``, as an array.

    A day that is itself a month end starts with the following one.
    """
    if periods < 1:
        return F.array().cast("array<date>")
    skip = (F.last_day(day) == day).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(periods - 1)),
        lambda i: F.last_day(F.add_months(F.trunc(day, "month"), i + skip)),
    )
