"""Display texts for amounts, dates and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUPEE = "₹"
LAKH = 100_000
THOUSAND = 1_000
DASH = "—"


def _amount(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("decimal(28,2)")


def _scaled(value: Column, unit: int, digits: int) -> Column:
    return F.round(value / F.lit(unit), digits).cast(f"decimal(28,{digits})").cast("string")


def whole(value: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(_amount(value) + F.lit(0.5).cast("decimal(2,1)")).cast("bigint")


def rupees(value: Column) -> Column:
    """``₹1.25L`` from a lakh, ``₹1.25K`` from a thousand, else whole rupees."""
    v = _amount(value)
    return (
        F.when(v >= LAKH, F.concat(F.lit(RUPEE), _scaled(v, LAKH, 2), F.lit("L")))
        .when(v >= THOUSAND, F.concat(F.lit(RUPEE), _scaled(v, THOUSAND, 2), F.lit("K")))
        .otherwise(whole_rupees(value))
    )


def whole_rupees(value: Column) -> Column:
    return F.concat(F.lit(RUPEE), whole(value).cast("string"))


def rupees_in_thousands(value: Column) -> Column:
    """Thousands with one decimal and no unit: ``₹12.3``."""
    return F.concat(F.lit(RUPEE), _scaled(_amount(value), THOUSAND, 1))


def long_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "dd MMM yyyy"), F.lit(DASH))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def percent(value: Column) -> Column:
    return F.concat(whole(value).cast("string"), F.lit("%"))


def or_default(text: Column, default: str) -> Column:
    """``text``, or ``default`` where it is NULL or empty."""
    return F.coalesce(F.nullif(text.cast("string"), F.lit("")), F.lit(default))
