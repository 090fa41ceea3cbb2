"""Draws at the positions of sequences, in numpy on Arrow batches: only what is drawn becomes a row.

Numbers are those of :func:`strandline.operators.simulate.draw`.  Positions are looked at a
stretch at a time, and a stretch gives its own least numbers, or its hits, so what is
shuffled grows with what is wanted and not with the bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .letters import AT_ONCE
from .rope import WIDTH, to_rope

#: Positions that are drawn for at once.
POSITIONS = 1 << 18


def numbers(seed: np.ndarray, at: np.ndarray, purpose: int) -> np.ndarray:
    """The numbers of ``draw``; remainders have the sign of what is divided, as in Spark."""
    x = np.fmod(at * 1103515245 + seed * 12345 + (purpose * 69069 + 12345), 2147483648)
    return np.fmod(x * 48271 + 11, 2147483647)


def least_draws(seqs: DataFrame, keys: list[str], n: int, seed: Column, purpose: int) -> DataFrame:
    """keys, pos, base, rank (from 1) of the ``n`` positions of each sequence (keys, seq) with the smallest draws, then places; all where a sequence is shorter."""
    ship(seqs.sparkSession)
    pieces = to_rope(seqs, tuple(keys)).where("piece <> ''").select(*keys, seed.cast("long").alias("_seed"), "chunk", "piece")
    kind = pieces.select(*keys, F.col("chunk").alias("pos"), F.col("piece").alias("base"), F.col("chunk").alias("_number")).schema
    k = len(keys)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        for batch in batches:
            for part in (batch.slice(i, AT_ONCE) for i in range(0, batch.num_rows, AT_ONCE)):
                seeds, chunk, texts = part.column(k).to_numpy(), part.column(k + 1).to_numpy(), part.column(k + 2).to_pylist()
                sizes = np.array([len(t) for t in texts])
                inside = np.arange(int(sizes.max()))
                at = chunk[:, None] * WIDTH + inside
                drawn = np.where(inside < sizes[:, None], numbers(seeds[:, None], at, purpose), np.iinfo(np.int64).max)
                best = np.argsort(drawn, axis=1, kind="stable")[:, :n]
                row, place = np.nonzero(np.arange(best.shape[1]) < sizes[:, None])
                i = best[row, place]
                base = [texts[r][p] for r, p in zip(row.tolist(), i.tolist())]
                own = [part.column(c).take(pa.array(row)) for c in range(k)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at[row, i]), pa.array(base, pa.string()), pa.array(drawn[row, i])], schema=names)

    some = pieces.mapInArrow(chosen, kind)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_number", "pos"))
    return some.withColumn("rank", rank).where(F.col("rank") <= n).drop("_number")


def hits(totals: DataFrame, chances: list[tuple[int, int]], seed: int) -> DataFrame:
    """seq_idx, total, pos, nth: the positions of each sequence (seq_idx, total) where a draw for one of ``chances`` (purpose, bound) is below its bound; nth is the first such."""
    ship(totals.sparkSession)
    ranges = totals.where("total > 0").select("seq_idx", F.col("total").cast("long").alias("total"), F.explode(F.expr(f"sequence(0L, cast(total as bigint) - 1, {POSITIONS}L)")).alias("pos"))
    kind = ranges.select("*", F.lit(0).cast("long").alias("nth")).schema

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        for batch in batches:
            ids, totals_, starts = (batch.column(c).to_numpy() for c in range(3))
            sizes = np.minimum(totals_ - starts, POSITIONS)
            group = np.cumsum(sizes) // POSITIONS  # rows that are drawn for together
            for rows in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(group)) + 1):
                if not len(rows):
                    continue
                row = np.repeat(rows, sizes[rows])
                begins = np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows])
                at = starts[row] + np.arange(len(row)) - begins
                seeds, nth = ids[row] + seed, np.full(len(row), -1, np.int64)
                for i, (purpose, bound) in enumerate(chances):
                    nth[(nth < 0) & (numbers(seeds, at, purpose) < bound)] = i
                hit = np.flatnonzero(nth >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[row[hit]], totals_[row[hit]], at[hit], nth[hit])], schema=names)

    return ranges.mapInArrow(found, kind)
