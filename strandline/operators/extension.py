"""Extension and fusion of window blocks along an alignment.

A block takes columns beyond either end while its mean score keeps ``share`` per cent of the
centre's own.  Both means have one width, so the test compares two running totals, and the
first column that fails it is found on arrays of prefix sums.  Likewise gaps pile up where,
since the last column without one, one of the rows has ``PATIENCE`` of them, or ``PATIENCE``
columns have half of all cells gapped; the block then ends with the first column of that
stretch.  A block that reaches the one before it, with the same rows, is fused with it.

Blocks of one alignment wait for each other's ends; alignments are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import GAP_EXTEND, GAP_OPEN, HOXD70
from ..session import ship
from ..storage import stored

SCHEMA = "aln_id long, start long, end long, rows string, score double, score_100 double"
#: Columns or cells that a stretch of gaps may have, and the share of the centre's score in per cent.
PATIENCE, SHARE = 5, 98.0
#: Blocks that are given at once.
GIVEN = 1 << 12

_GAP = ord("-")
_SCORES = np.zeros((256, 256))
for _pair, _value in HOXD70.items():
    _SCORES[ord(_pair[0]), ord(_pair[1])] = _SCORES[ord(_pair[1]), ord(_pair[0])] = _value


class Block(NamedTuple):
    start: int
    end: int
    rows: tuple[int, ...]
    score: float
    score_100: float

    @property
    def width(self) -> int:
        return self.end - self.start


class Sheet:
    """The letters of an alignment; row 0 is the centre."""

    def __init__(self, seqs: dict[int, str]):
        self.place = {r: i for i, r in enumerate(seqs)}
        self.letters = np.stack([np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8) for s in seqs.values()])
        self.centre = self.letters[self.place[0]]

    @property
    def columns(self) -> int:
        return self.letters.shape[1]

    def rows(self, rows: tuple[int, ...], columns: np.ndarray) -> np.ndarray:
        return self.letters[np.ix_([self.place[r] for r in rows], columns)]


def column_costs(broken: np.ndarray, edge: np.ndarray, paired: np.ndarray) -> np.ndarray:
    """Mean score of each column: a substitution, or a gap that opens or goes on from the column before (``edge`` for the first)."""
    before = np.column_stack([edge, broken[:, :-1]])
    return np.where(broken, np.where(before, GAP_EXTEND, GAP_OPEN), paired).mean(axis=0)


def gap_pile(open_: np.ndarray) -> tuple[int, int] | None:
    """(column, first column of its stretch) where gaps first pile up."""
    n = open_.shape[1]
    some = open_.any(axis=0)
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(some, -1, at)) + 1  # behind the last column without a gap
    sums = np.concatenate([np.zeros((len(open_), 1), dtype=np.int64), np.cumsum(open_, axis=1)], axis=1)
    inside = sums[:, 1:] - sums[:, first * some]
    long = at - first + 1
    piled = np.flatnonzero(some & ((inside.max(axis=0) >= PATIENCE) | ((long >= PATIENCE) & (inside.sum(axis=0) >= long * len(open_) // 2))))
    return (int(piled[0]), int(first[piled[0]])) if len(piled) else None


def extended(sheet: Sheet, block: Block, columns: np.ndarray, share: float = SHARE) -> Block:
    """``block`` with as many of ``columns``, listed from its end outwards, as it takes."""
    if not len(columns):
        return block
    step = 1 if columns[0] >= block.end else -1
    own, centre = sheet.rows(block.rows, columns), sheet.centre[columns]
    open_ = own == _GAP
    edge = sheet.rows(block.rows, columns[:1] - step)[:, 0] == _GAP
    costs = column_costs(open_ | (centre == _GAP), edge, _SCORES[centre[None, :], own])
    have = block.score * block.width + 100 * np.cumsum(costs)
    full = block.score_100 * block.width + 100 * np.cumsum(_SCORES[centre, centre])
    fails = np.flatnonzero(have < full * share / 100)
    n = int(fails[0]) if len(fails) else len(columns)
    pile = gap_pile(open_[:, :n]) if n else None
    if pile:
        n = pile[1] + 1
    if not n:
        return block
    width = block.width + n
    ends = {"end": block.end + n} if step > 0 else {"start": block.start - n}
    return block._replace(**ends, score=float(have[n - 1] / width), score_100=float(full[n - 1] / width))


def fused(before: Block, after: Block) -> Block:
    """Both as one, scores weighted by width."""
    weights = (before.width, after.width)
    mean = lambda *x: float(np.average(x, weights=weights))
    return Block(before.start, after.end, before.rows, mean(before.score, after.score), mean(before.score_100, after.score_100))


def extend_all(sheet: Sheet, blocks: list[Block], share: float = SHARE) -> list[Block]:
    """The blocks, in order, each extended to the end of the one before and the start of the next."""
    done: list[Block] = []
    for block, until in zip(blocks, [*(b.start for b in blocks[1:]), sheet.columns]):
        since = done[-1].end if done else 0
        block = extended(sheet, block, np.arange(block.start - 1, since - 1, -1), share)
        if done and (block.start, block.rows) == (since, done[-1].rows):
            block = fused(done.pop(), block)
        done.append(extended(sheet, block, np.arange(block.end, until), share))
    return done


def extend_blocks(aln: DataFrame, merged: DataFrame, width: int = 100, share: float = SHARE) -> DataFrame:
    """aln_id, start, end, rows, score, score_100 of extended and fused blocks of merged windows.

    Rows and, behind them, blocks of one alignment pass one behind the other, many alignments
    in a task, so none needs a group of its own.
    """

    ship(aln.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    found = ["first_win", "n_win", "rows", "score", "score_100"]
    merged = stored(merged, "merged-windows")
    with_blocks = aln.join(merged.select("aln_id").distinct(), "aln_id", "left_semi")
    letters = with_blocks.select("aln_id", "row_idx", "seq", *(none(merged.schema[c].dataType).alias(c) for c in found))
    blocks = merged.select("aln_id", none("long").alias("row_idx"), none("string").alias("seq"), *found)
    both = letters.unionByName(blocks).repartition("aln_id").sortWithinPartitions("aln_id", "first_win")
    kind = aln.select("aln_id", *(none(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")[1:])).schema

    def ends(aln_id, seqs: dict[int, str], own: list[tuple]) -> list[tuple]:
        if not own or 0 not in seqs:
            return []
        sheet = Sheet(seqs)
        given = [Block(first * width, min((first + n) * width, sheet.columns), tuple(map(int, rows.split(","))), score, score_100) for first, n, rows, score, score_100 in own]
        return [(aln_id, int(b.start), int(b.end), ",".join(map(str, b.rows)), b.score, b.score_100) for b in extend_all(sheet, given, share)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        given = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)
        at, seqs, own, held = None, {}, [], []
        for batch in batches:
            for aln_id, row_idx, seq, *block in zip(*(c.to_pylist() for c in batch.columns)):
                if aln_id != at:
                    held.extend(ends(at, seqs, own))
                    at, seqs, own = aln_id, {}, []
                if row_idx is None:
                    own.append(tuple(block))
                else:
                    seqs[row_idx] = seq
            if len(held) > GIVEN:
                yield given(held)
                held = []
        held.extend(ends(at, seqs, own))
        if held:
            yield given(held)

    return both.mapInArrow(run, kind)
