"""Sequence files that arrive in a folder, parsed as they come.

Each micro-batch has whole files, so the batch parsers apply to it unchanged; a
checkpoint lets the stream go on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def lines_of(files: DataFrame) -> DataFrame:
    """Lines (file, block, at, line) of whole-text rows (file, value)."""
    return files.select("file", F.lit(0).cast("long").alias("block"), F.posexplode(F.split("value", "\r?\n", -1)).alias("at", "line")).where("not (line = '' and at = 0)")


def parse_folder(spark: SparkSession, folder: str, parser: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Parses new files of ``folder`` into the Parquet table ``sink``, a partition ``batch`` for each micro-batch.

    A batch that is repeated after a failure replaces its own partition, so each row is there once.
    """
    files = spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).text(folder).select(F.col("_metadata.file_path").alias("file"), "value")

    def put(batch: DataFrame, number: int) -> None:
        parser(lines_of(batch)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
