"""A global row number whose tasks stay bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids that share all but their low 20 bits form a block: at most 1,048,576 rows.
BLOCK_BITS = 20


def number_rows(df: DataFrame, score: str, unique_id: str, alias: str = "rank") -> DataFrame:
    """Adds ``alias`` = position in the order (``score`` descending, ``unique_id``).

    Rows of one score and one block of ids are a range of that order. A row's number is the number of rows in
    the ranges before its own, plus its place in it:

    * a range holds at most 1,048,576 rows, as ids are unique; its task sorts them and may spill;
    * only the sizes of the ranges meet in one task. A score has at most 4,096 blocks, as user ids are 32-bit integers. Scores are
      order counts, so N orders give at most about 90 sqrt(N) ranges, and far fewer where ids are given out one after the other:
      a billion ids are 954 blocks.

    A score shared by a third of all rows is thereby spread over its blocks. The sizes are the one other use of ``df``.
    """
    block = "_block"
    blocked = df.withColumn(block, F.shiftright(F.col(unique_id), BLOCK_BITS))
    # The sizes look at all columns, so that both uses of ``df`` read the same ones and Spark
    # makes it once: it would cut the columns of one that needs fewer, and scan its tables again.
    sizes = (
        blocked.groupBy(score, block).agg(F.count(F.lit(1)).alias("_n"), F.max(F.xxhash64(*df.columns)).alias("_all"))
        .filter(F.col("_all").isNotNull()).drop("_all")
    )
    before = F.sum("_n").over(Window.orderBy(F.desc(score), block).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(score, block, F.coalesce(before, F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(score, block).orderBy(unique_id))
    return blocked.withColumn("_place", place).join(offsets, [score, block]).select(
        *df.columns, (F.col("_offset") + F.col("_place")).cast("bigint").alias(alias))
