"""Order-date parsing, month arithmetic and date labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two spellings of an order date. The first is matched to the
# very end of the text (\z, not $, which would let a trailing line break pass);
# the second only at its start, whatever follows.
DASHED = r"^\d{2}-\d{2}-\d{4}\z"
SLASHED = r"^\d{2}/\d{2}/\d{4}"


def looks_like_date(text: Column) -> Column:
    return F.coalesce(text.rlike(f"{DASHED}|{SLASHED}"), F.lit(False))


def parse_order_date(text: Column, strict: bool = False) -> Column:
    """The order date in ``text``; NULL where it has neither spelling.

    A text that is spelled like a date but names no day (``02/30/2026``) gives
    NULL as well, or stops the query when ``strict``. Of the slashed spelling
    only the ten characters of the day are read; the time of day is not checked.
    """
    # Month, day and year stand at the same places in both spellings. Turned
    # round they make an ISO date, which is cast faster than a pattern is parsed.
    iso = F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 1, 2), F.substring(text, 4, 2))
    parsed = F.when(looks_like_date(text), iso.try_cast("date"))
    if not strict:
        return parsed
    complaint = F.raise_error(F.concat(F.lit("no such order date: "), text)).cast("date")
    return F.when(looks_like_date(text) & parsed.isNull(), complaint).otherwise(parsed)


def month_start(day: Column, months: int = 0) -> Column:
    """First day of ``day``'s month, ``months`` later."""
    first = F.trunc(day, "month")
    return F.add_months(first, months) if months else first


def as_date(value: dt.date | str) -> dt.date:
    """A date given by a caller; anything that is no ISO date is refused here,
    before a job starts."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(value)


def as_month(value: str) -> dt.date:
    """First day of a month written ``YYYY-MM``."""
    return dt.date.fromisoformat(f"{value}-01")


def month_title(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def month_tick(day: Column) -> Column:
    return F.date_format(day, "MMM ''yy")


def day_tick(day: Column) -> Column:
    return F.date_format(day, "dd/MM")
