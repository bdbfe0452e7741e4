"""Marks of rows by their numbers: a 64-bit number for 64 rows, so that deleted rows need no rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks are broadcast up to so many deleted rows; a mark is less than 200 bytes.
BROADCAST_MARKS = 100_000


def word_of(row: Column) -> Column:
    return F.shiftright(row, 6)


def bit_of(row: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), row.bitwiseAND(F.lit(63)).cast("int"))


def marked(rows: DataFrame, row: Column, *keys: str) -> DataFrame:
    """The rows' numbers as marks: a number's 64 bits stand for 64 rows."""
    words = rows.select(*keys, word_of(row).alias("word"), bit_of(row).alias("bit"))
    return words.groupBy(*keys, "word").agg(F.bit_or("bit").alias("bits"))


def unmarked(rows: DataFrame, row: Column, marks: DataFrame, count: int, *keys: str) -> DataFrame:
    """rows whose number isn't marked; count is how many are."""
    marks = marks.groupBy(*keys, "word").agg(F.bit_or("bits").alias("_bits"))
    marks = F.broadcast(marks) if count <= BROADCAST_MARKS else marks
    found = rows.withColumn("word", word_of(row)).join(marks, [*keys, "word"], "left")
    return found.where(F.coalesce(F.col("_bits").bitwiseAND(bit_of(row)) == 0, F.lit(True))).drop("_bits", "word", *keys)
