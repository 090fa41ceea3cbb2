"""Helpers that the operators of this subpackage share: tables, stored cuts, batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with at most ``max_bytes`` of ``column`` each, a longer row alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def most_frequent(counts: DataFrame, most: int, name: str) -> DataFrame:
    """At most ``most`` rows of ``counts`` (``name``, n): those with the largest n, ties by hash.

    A histogram of n (a row for each value that occurs, summed before it is shuffled) gives the
    smallest n that is taken whole, so no task and no driver sees more than the result.
    """
    left, least, share = most, None, 0.0
    for n, rows in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if rows > left:
            share = left / rows
            break
        left, least = left - rows, n
    whole = counts.where(F.lit(False) if least is None else F.col("n") >= least)
    if not share:
        return whole
    tied = counts.where((F.col("n") == n) & (F.pmod(F.xxhash64(name), F.lit(2**31)) < int(share * 2**31))).orderBy(F.xxhash64(name)).limit(left)
    return whole.unionByName(tied)


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, returning freed memory after each task.

    Python workers are used again by later tasks, so what one task's batches and tables
    took would stay with the worker beside what the next ones take.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped
