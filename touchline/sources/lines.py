"""Text files line by line, in the order of the file, however many tasks read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOW = (1 << 33) - 1


def in_order(rows: DataFrame) -> DataFrame:
    """rows of a file source with `_file` and `_line`, which grows along a file: the start of the row's split, then its place in the task that read it.

    A split is read by one task from its first to its last row, and splits are named by where they start, so no row has to know how many stand before its split. _line orders rows, it doesn't count them.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)).cast("decimal(20,0)")
    start = F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(11,0)")
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), (start + place).cast("decimal(38,0)").alias("_line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _line) of the text files at path."""
    return in_order(spark.read.text(path))


def fields(value: Column, n: int) -> list[Column]:
    """The first n comma-separated fields as numbers, null where one isn't a number."""
    parts = F.split(value, ",")
    return [F.get(parts, F.lit(k)).try_cast("double") for k in range(n)]


def numbered(lines: DataFrame) -> DataFrame:
    """lines with `line`, their number in their file, from 1. The splits' sizes are summed, a row for each of them."""
    from pyspark.sql.window import Window

    split = F.floor(F.col("_line") / F.lit(1 << 33)).cast("long")
    t = lines.withColumn("_split", split)
    own = t.groupBy("_file", "_split").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    own = own.select("_file", "_split", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return t.join(own, ["_file", "_split"]).withColumn("line", (F.col("_line") - F.col("_first") + F.col("_before") + 1).cast("long")).drop("_split", "_first", "_before")
