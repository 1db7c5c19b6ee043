"""Words of a text: runs of characters other than blanks and the controls 9 to 13."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that parts words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words in order, as an array; of a null text none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")
