"""Text helpers: comma lists, trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def primary_member(listing: Column) -> Column:
    """First entry of a comma list, without surrounding blanks."""
    return F.trim(F.split_part(listing, F.lit(","), F.lit(1)))


def members(listing: Column) -> Column:
    """All entries of a comma list, without blanks or line breaks around them."""
    return F.transform(F.split(listing, ","), lambda m: F.trim(m, F.lit(" \n\r\t")))


def is_filled(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
