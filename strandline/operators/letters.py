"""Letters of chunks as numpy matrices, and what the columns of an alignment hold.

Chunks of one stretch of columns lie one behind the other in a task, sorted as strings, and
are counted as they pass: a task holds some hundred chunks and one row of counts for each
column of a stretch, whatever the number of rows or the size of the table.  No cell becomes a
row of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import columns
from .columns import stretches

GAP = ord("-")
#: Chunks that are looked at together, which bounds a task's matrices.
AT_ONCE = 512


def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of each text in a row, filled up with 0; lengths): bytes where all are ASCII, else code points."""
    code, kind = ("ascii", np.uint8) if all(t.isascii() for t in texts) else ("utf-32-le", np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(int(sizes.max(initial=0)), 1)), kind)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode(code, "surrogatepass" if code != "ascii" else "strict"), kind)
    return out, sizes


class Stretch:
    """What is known of one stretch of columns so far: how many rows have each symbol, and the least and greatest letter."""

    def __init__(self, symbols: str, columns: int):
        self.counts = np.zeros((len(symbols), columns), np.int64)
        self.low, self.high = np.full(columns, 2**32 - 1, np.int64), np.zeros(columns, np.int64)
        self.width = 0

    def add(self, counts: list[np.ndarray], low: np.ndarray, high: np.ndarray, width: int) -> None:
        self.width = max(self.width, width)
        for own, new in zip(self.counts, counts):
            own[: len(new)] += new
        np.minimum(self.low[: len(low)], low, out=self.low[: len(low)])
        np.maximum(self.high[: len(high)], high, out=self.high[: len(high)])


def _passed(batches: Iterator[pa.RecordBatch], symbols: str, chunk: int) -> Iterator[tuple[object, int, Stretch]]:
    """(aln_id, chunk, its columns) of sorted rows aln_id, chunk, piece, each as soon as it is whole."""
    at, known = None, None
    for batch in batches:
        for part in (batch.slice(i, AT_ONCE) for i in range(0, batch.num_rows, AT_ONCE)):
            keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            letters, sizes = matrix(part.column(2).to_pylist())
            begins = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            inside = np.arange(letters.shape[1]) < sizes[:, None]
            counts = [np.add.reduceat((letters == ord(s)).astype(np.int32), begins, axis=0) for s in symbols]
            low = np.minimum.reduceat(np.where(inside, letters, 2**32 - 1), begins, axis=0)
            high, width = np.maximum.reduceat(letters, begins, axis=0), np.maximum.reduceat(sizes, begins)
            for g, i in enumerate(begins):
                if known is None or keys[i] != at:
                    if known is not None:
                        yield *at, known
                    at, known = keys[i], Stretch(symbols, chunk)
                w = int(width[g])
                known.add([c[g, :w] for c in counts], low[g, :w], high[g, :w], w)
    if known is not None:
        yield *at, known


def by_stretch(aln: DataFrame, schema: str, made: Callable[[object, int, Stretch], list[np.ndarray]], symbols: str) -> DataFrame:
    """Rows (aln_id, ``schema``) that ``made`` gives for each stretch of columns of an alignment (aln_id, row_idx, seq) and its first column, as columns of numpy."""
    ship(aln.sparkSession)
    kind, width = aln.schema["aln_id"].dataType, columns.CHUNK  # workers import their own
    fields = aln.select("aln_id", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", "))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

        names, id_type = to_arrow_schema(fields), to_arrow_type(kind)
        held, n = [], 0

        def batch() -> pa.RecordBatch:
            ids = pa.array([i for i, _ in held], id_type).take(pa.array(np.repeat(np.arange(len(held)), [len(c[0]) for _, c in held])))
            whole = [np.concatenate(c) for c in zip(*(c for _, c in held))]
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(whole, list(names)[1:]))], schema=names)

        for aln_id, chunk, stretch in _passed(batches, symbols, width):
            found = made(aln_id, chunk * width, stretch)
            held.append((aln_id, found))
            n += len(found[0])
            if n > 1 << 16 or len(held) > 1 << 12:
                yield batch()
                held, n = [], 0
        if held:
            yield batch()

    return stretches(aln).sortWithinPartitions("aln_id", "chunk").select("aln_id", "chunk", "piece").mapInArrow(run, fields)
