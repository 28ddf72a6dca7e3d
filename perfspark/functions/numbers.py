"""Arithmetic that does not stop a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where the divisor is 0.  Means skip such rows, so
    reports count them beside."""
    return F.try_divide(top, bottom)


def scale_of(spread: Column) -> Column:
    """A divisor for centred values: 1 where nothing varies."""
    return F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def log_stamp(seconds: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since 1970 as the text of a moment, in the session's time zone."""
    return F.date_format(F.timestamp_millis(F.round(seconds * 1000).cast("bigint")), form)
