"""Ordered lines of text files, without reading a file in one task.

A line's order comes from its file, the byte where its split begins and its place in
the split; numbers across splits come from a small table with one row a split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, at, line: folders are read recursively; carriage returns are dropped."""
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))


def number(lines: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """file, line_no (from 0), line, and for each mark how many marked lines a line's file has up to it."""
    flagged = lines.withColumns({k: F.coalesce(v.cast("long"), F.lit(0)) for k, v in marks.items()})
    inside = Window.partitionBy("file", "block").orderBy("at")
    counted = flagged.withColumns({"line_no": (F.row_number().over(inside) - 1).cast("long")} | {k: F.sum(k).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for k in marks})
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = flagged.groupBy("file", "block").agg(F.count("*").alias("_lines"), *(F.sum(k).alias(f"_{k}") for k in marks))
    offsets = totals.select("file", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["_lines", *(f"_{k}" for k in marks)]))
    joined = counted.join(offsets, ["file", "block"])
    return joined.select("file", (F.col("line_no") + F.col("_lines")).alias("line_no"), "line", *((F.col(k) + F.col(f"_{k}")).alias(k) for k in marks))


def write_text(df: DataFrame, path: str, order: list[str]) -> None:
    """Writes the column ``text`` in order, in range partitions whose file names follow it."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.text(path)


def six_digits(value: Column) -> Column:
    """A number with six significant digits and no trailing zeros; the number itself is rounded, and only its exact ties go to the even digit.

    The digits must come from the binary number: its shortest decimal form, or its product
    with a power of ten, can be a tie where the number is none.
    """

    @F.arrow_udf("string")
    def shown(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.6g}" for v in values.to_pylist()], pa.string())

    return shown(value.cast("double"))
