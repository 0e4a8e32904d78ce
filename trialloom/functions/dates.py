"""Date rules. Every rule takes ``as_of``; nothing here reads the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def day(as_of: dt.date) -> Column:
    return F.lit(as_of).cast("date")


def months_since(date: Column, as_of: dt.date) -> Column:
    """Whole months from ``date`` to ``as_of``.

    ``months_between`` treats two month ends as a full month apart (31 Jan to
    28 Feb gives 1); ``timestampdiff`` counts completed months (0).
    """
    return F.timestamp_diff("MONTH", date.cast("timestamp_ntz"), day(as_of).cast("timestamp_ntz")).cast("int")


def older_than(date: Column, as_of: dt.date, months: int = C.OUTDATED_AFTER_MONTHS) -> Column:
    return F.coalesce(date <= F.add_months(day(as_of), -months), F.lit(False))


def within_last_year(date: Column, as_of: dt.date) -> Column:
    return F.coalesce(date >= F.add_months(day(as_of), -12), F.lit(False))


def in_same_period(date: Column, as_of: dt.date, unit: str) -> Column:
    """``date`` lies in the calendar ``unit`` ('month' or 'year') that holds ``as_of``."""
    start = F.trunc(day(as_of), unit)
    end = F.add_months(start, 12 if unit == "year" else 1)
    return F.coalesce((date >= start) & (date < end), F.lit(False))
