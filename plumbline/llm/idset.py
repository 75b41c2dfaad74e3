"""A set of ids as a bitmap of fixed size, to leave most other rows out before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^23 bits in words of 64: one or two megabytes, whatever the number of ids. With many more ids than that most rows
#: pass, and the exact join behind it does all the work.
BITS = 1 << 23


def maybe_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among the values of the first column of ``ids`` (never leaves one out)."""
    cell = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(BITS))
    word, bit = (lambda c: F.shiftright(c, 6)), (lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int")))
    cells = ids.select(cell(ids[ids.columns[0]]).alias("_cell"))
    words = cells.groupBy(word(F.col("_cell")).alias("_word")).agg(F.bit_or(bit(F.col("_cell"))).alias("_bits"))
    marked = df.withColumn("_cell", cell(df[column])).withColumn("_word", word(F.col("_cell")))
    return marked.join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit(F.col("_cell"))) != 0).select(df.columns)
