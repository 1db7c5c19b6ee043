"""Records of large CSV files whose quoted fields may hold line breaks, read by many tasks.

Spark cuts the files into splits, and these into blocks of lines. What a line does to the quotes is one of four functions of whether it begins inside
a quoted field; they are composed over the lines of a block, then over the blocks of a file, which tells for every
line whether a record begins there. Most records are one line. Only the lines of the others are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where a record begins: file, place of the block in the file, place of the line in the block.
PLACE = ["_file", "_split", "_line"]
RECORD_TEXT = "_text"
#: Whether a record is the first of its file.
FIRST = "_is_first"

# A block: a run of lines of one split of a file, short enough to be dealt out evenly and sorted in memory.
_BLOCK = [*PLACE[:2], "_part"]
_LINES = 1 << 16
# States within a line: at its start, in an unquoted field, inside quotes, after a quote that may close them.
_START, _PLAIN, _QUOTED, _CLOSING = 0, 1, 2, 3


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: its text, ``PLACE`` and ``FIRST``. Empty lines between records are none.

    Quotes open a field only at its beginning, and are doubled inside. A line break is ``\\n`` or ``\\r\\n`` and
    comes out as ``\\n``. A file that ends inside quotes is refused, since the rest of it would be one record.
    """
    text = F.regexp_replace("value", "\r$", "")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]),
        F.monotonically_increasing_id().alias(PLACE[2]), text.alias(RECORD_TEXT))
    lines = lines.withColumn(_BLOCK[2], F.shiftright(PLACE[2], _LINES.bit_length() - 1))
    quotes, full = F.col(RECORD_TEXT).contains('"'), F.col(RECORD_TEXT) != ""
    lines = lines.select("*", *(F.when(quotes, _after(state)).alias(name) for state, name in ((_START, "_from_plain"), (_QUOTED, "_from_quoted"))))

    # Parity of the swaps so far, and the last line that ends the same way whichever way it begins.
    running = Window.partitionBy(*_BLOCK).orderBy(PLACE[2])
    before = running.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("_from_plain") == F.col("_from_quoted")
    swaps = F.coalesce((F.col("_from_plain") & ~F.col("_from_quoted")).cast("int"), F.lit(0))
    lines = lines.withColumn("_swaps", F.sum(swaps).over(running.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("_swaps_before", F.col("_swaps") - swaps)
    settled = F.when(fixed, (F.col("_from_plain").cast("int") + F.col("_swaps")) % 2)
    lines = lines.withColumn("_settled", F.last(settled, ignorenulls=True).over(before))

    def inside(entered: Column) -> Column:
        """Whether the line begins inside quotes, if its block does."""
        return (F.coalesce("_settled", entered.cast("int")) + F.col("_swaps_before")) % 2 == 1

    def ends_inside(entered: Column) -> Column:
        begins = inside(entered)
        return F.when(begins, F.coalesce("_from_quoted", F.lit(True))).otherwise(F.coalesce("_from_plain", F.lit(False)))

    # Whether no line before it in its block holds anything.
    lines = lines.withColumn("_leads", full & (F.count(F.when(full, 1)).over(before) == 0))

    blocks = lines.groupBy(*_BLOCK).agg(
        *(F.max_by(ends_inside(F.lit(e)), PLACE[2]).alias(f"_ends_{e}") for e in (False, True)),
        *(F.max(F.when(full & ~inside(F.lit(e)), F.col(PLACE[2]))).alias(f"_last_{e}") for e in (False, True)))
    # Where no record has begun in a block before, the file's first begins.
    lines = lines.join(_entered(blocks), _BLOCK).withColumn(FIRST, F.col("_leads") & F.col("_open").isNull())

    begins, ends = ~inside(F.col("_inside")), ~ends_inside(F.col("_inside"))
    whole = lines.filter(begins & ends & full).select(*PLACE, RECORD_TEXT, FIRST)
    # The line that a part of a record begins with: in its block, or the last to begin one in a block before.
    first = F.last(F.when(begins, F.struct(PLACE[1], PLACE[2])), ignorenulls=True).over(running)
    parts = lines.withColumn("_first", F.coalesce(first, F.col("_open"))).filter(~(begins & ends))
    joined = parts.groupBy(PLACE[0], "_first").agg(F.array_sort(F.collect_list(F.struct(PLACE[1], PLACE[2], RECORD_TEXT))).alias("_parts"),
                                                     F.max(FIRST).alias(FIRST))
    split = joined.select(PLACE[0], F.col(f"_first.{PLACE[1]}"), F.col(f"_first.{PLACE[2]}"),
                          F.array_join(F.col(f"_parts.{RECORD_TEXT}"), "\n").alias(RECORD_TEXT), FIRST)
    return whole.unionByName(split)


def _after(state: int) -> Column:
    """Whether the line ends inside quotes if it begins in ``state``: its quotes one by one, each with the text before it."""
    pieces = F.split(RECORD_TEXT, '"', -1)

    def quote(at: Column, before: Column) -> Column:
        opens = before.endswith(",") | ((at == _START) & (before == ""))
        return F.when(at == _QUOTED, _CLOSING).when((at == _CLOSING) & (before == ""), _QUOTED).when(opens, _QUOTED).otherwise(_PLAIN)

    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(state), quote) == _QUOTED


def _entered(blocks: DataFrame) -> DataFrame:
    """Of each block: whether it begins inside quotes, and the line that then began the record. One row a block, so a file's fit one task."""
    order = Window.partitionBy(PLACE[0]).orderBy(*_BLOCK[1:])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("_ends_False") == F.col("_ends_True")
    swap = (F.col("_ends_False") & ~F.col("_ends_True")).cast("int")
    found = blocks.withColumn("_sum", F.sum(swap).over(upto))
    settled = F.when(fixed, (F.col("_ends_False").cast("int") + F.col("_sum")) % 2)
    found = found.withColumn("_inside", (F.coalesce(F.last(settled, ignorenulls=True).over(before), F.lit(0)) + F.col("_sum") - swap) % 2 == 1)
    last = F.when(F.col("_inside"), F.col("_last_True")).otherwise(F.col("_last_False"))
    found = found.withColumn("_open", F.last(F.when(last.isNotNull(), F.struct(F.col(PLACE[1]), last.alias(PLACE[2]))), ignorenulls=True).over(before))
    ends = F.when(F.col("_inside"), F.col("_ends_True")).otherwise(F.col("_ends_False"))
    closed = (F.lead(PLACE[1]).over(order).isNull() & ends)
    refused = F.raise_error(F.concat(F.lit("quotes are not closed in "), F.col(PLACE[0]))).cast("boolean")
    return found.select(*_BLOCK, F.when(closed, refused).otherwise(F.col("_inside")).alias("_inside"), "_open")
