"""Pairs of rows as chunks, and summaries of chunks that add up to those of whole pairs.

A summary is what a chunk means to its neighbours, whatever they are: for the
maximum-scoring segment its total, its least and greatest prefix sum with their first
places, and its own best segment; for affine scores its score, whether its first counted
column is gapped, and its last gap state.  Summaries are made for many chunks at once, in
numpy on Arrow batches, and are put together in the chunks' order by windows over one row
a chunk, so a pair is spread over tasks and may be of any length.

Letters are compared as they are; what is not ASCII is one symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import GAP_EXTEND, GAP_OPEN, HOXD70
from .columns import CHUNK

GAP, N = ord("-"), ord("N")
#: Chunks that are summarised at once, which bounds a batch's matrices.
AT_ONCE = 256
_FAR = np.iinfo(np.int64).max // 4

_HOXD = np.zeros((256, 256), np.int64)
for _pair, _value in HOXD70.items():
    _HOXD[ord(_pair[0]), ord(_pair[1])] = _HOXD[ord(_pair[1]), ord(_pair[0])] = _value


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters of each string in a row, filled up with 0; lengths)."""
    texts = [(t or "").encode("ascii", "replace") for t in column.to_pylist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(int(sizes.max(initial=0)), 1)), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return out, sizes


def _in_parts(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    for at in range(0, len(columns[0]), AT_ONCE):
        yield tuple(c.slice(at, AT_ONCE) for c in columns)


def _summarise(parts: Callable[..., dict[str, np.ndarray]], kind: pa.StructType, columns: tuple[pa.Array, ...]) -> pa.Array:
    found = [parts(*part) for part in _in_parts(*columns)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([f[field.name] for f in found]) if found else [], field.type) for field in kind], fields=list(kind))


def pair_parts(pairs: DataFrame, *keys: str, width: int = CHUNK) -> DataFrame:
    """keys, chunk, a, b: aligned strings a and b of one row, cut; an empty pair has one empty chunk."""
    parts = lambda c: F.when(F.length(c) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(c, F.lit("(?s).{1,%d}" % width), F.lit(0)))
    cut = pairs.select(*keys, F.posexplode(F.arrays_zip(parts("a").alias("a"), parts("b").alias("b"))).alias("chunk", "p"))
    return cut.select(*keys, "chunk", "p.a", "p.b").repartition(*keys, "chunk")


# ---- the maximum-scoring segment


def _segment_summary(match: int, mismatch: int, gap: int) -> Callable[[Column, Column], Column]:
    names = ["total", "low", "low_at", "high", "high_at", "score", "start", "stop"]
    kind = pa.struct([(n, pa.int64()) for n in names])

    def parts(a: pa.Array, b: pa.Array) -> dict[str, np.ndarray]:
        (x, sizes), (y, _) = _matrix(a), _matrix(b)
        cost = np.where((x == GAP) | (y == GAP), gap, np.where((x == N) | (y == N), 0, np.where(x == y, match, mismatch))).astype(np.int64)
        inside = np.arange(x.shape[1]) < sizes[:, None]
        sums = np.cumsum(np.where(inside, cost, 0), axis=1)
        before = np.concatenate([np.zeros((len(sums), 1), np.int64), sums[:, :-1]], axis=1)
        lows = np.minimum.accumulate(before, axis=1)
        gain = np.where(inside, sums - lows, -_FAR)
        rows, stop = np.arange(len(sums)), gain.argmax(axis=1)
        start = (before == lows[rows, stop][:, None]).argmax(axis=1)
        low_at, high_at = np.where(inside, sums, _FAR).argmin(axis=1), np.where(inside, sums, -_FAR).argmax(axis=1)
        empty = sizes == 0
        pick = lambda at, other: np.where(empty, other, sums[rows, at])
        return {"total": sums[:, -1], "low": pick(low_at, _FAR), "low_at": low_at, "high": pick(high_at, -_FAR), "high_at": high_at, "score": gain[rows, stop], "start": start, "stop": stop}

    @F.arrow_udf("struct<" + ", ".join(f"{n}: bigint" for n in names) + ">")
    def summary(a: pa.Array, b: pa.Array) -> pa.Array:
        return _summarise(parts, kind, (a, b))

    return summary


def best_segments(chunks: DataFrame, keys: list[str], match: int = 1, mismatch: int = -2, gap: int = -2, width: int = CHUNK) -> DataFrame:
    """keys, score, start, stop (inclusive) of the first maximum-scoring segment of each pair; null where nothing is positive.

    A segment begins behind the first place of the least prefix sum before its end, so a
    chunk's best segment either begins in it or behind the least sum of the chunks before.
    """
    made = chunks.select(*keys, "chunk", _segment_summary(match, mismatch, gap)("a", "b").alias("s")).select(*keys, "chunk", (F.col("chunk").cast("long") * width).alias("base"), "s.*")
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    summed = made.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0).cast("long")))
    lows = F.min(F.struct((F.col("before") + F.col("low")).alias("value"), (F.col("base") + F.col("low_at") + 1).alias("begin"))).over(earlier)
    none = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("begin"))
    known = summed.withColumn("least", F.least(F.coalesce(lows, none), none))
    found = lambda score, start, stop: F.struct(score.alias("score"), (-stop).alias("stop"), (-start).alias("start"))
    across = found(F.col("before") + F.col("high") - F.col("least.value"), F.col("least.begin"), F.col("base") + F.col("high_at"))
    within = found(F.col("score"), F.col("base") + F.col("start"), F.col("base") + F.col("stop"))
    best = known.groupBy(*keys).agg(F.max(F.greatest(across, within)).alias("m"))
    positive = F.col("m.score") > 0
    return best.select(*keys, F.when(positive, F.col("m.score")).alias("score"), F.when(positive, -F.col("m.start")).alias("start"), F.when(positive, -F.col("m.stop")).alias("stop"))


# ---- affine scores and matches


def _affine_summary(match: int, mismatch: int, gap_open: int, gap_extend: int) -> Callable[[Column, Column], Column]:
    kind = pa.struct([("score", pa.int64()), ("counted", pa.bool_()), ("first", pa.bool_()), ("last", pa.bool_()), ("matches", pa.int64())])

    def parts(a: pa.Array, b: pa.Array) -> dict[str, np.ndarray]:
        (x, sizes), (y, _) = _matrix(a), _matrix(b)
        inside = np.arange(x.shape[1]) < sizes[:, None]
        counted = inside & ~((x == GAP) & (y == GAP))
        gapped = counted & ((x == GAP) | (y == GAP))
        at = np.arange(x.shape[1])
        last = np.maximum.accumulate(np.where(counted, at, -1), axis=1)
        before = np.concatenate([np.full((len(x), 1), -1), last[:, :-1]], axis=1)
        goes_on = (before >= 0) & np.take_along_axis(gapped, np.maximum(before, 0), axis=1)
        plain = np.where((x == N) | (y == N), 0, np.where(x == y, match, mismatch))
        cost = np.where(gapped, np.where(goes_on, gap_extend, gap_open), np.where(counted, plain, 0))
        some, rows = counted.any(axis=1), np.arange(len(x))
        return {
            "score": cost.sum(axis=1), "counted": some, "first": gapped[rows, counted.argmax(axis=1)], "last": gapped[rows, np.maximum(last[:, -1], 0)],
            "matches": (inside & (x == y) & (x != GAP) & (x != N)).sum(axis=1),
        }

    @F.arrow_udf("struct<score: bigint, counted: boolean, first: boolean, last: boolean, matches: bigint>")
    def summary(a: pa.Array, b: pa.Array) -> pa.Array:
        return _summarise(parts, kind, (a, b))

    return summary


def affine_scores(chunks: DataFrame, keys: list[str], match: int, mismatch: int, gap_open: int, gap_extend: int) -> DataFrame:
    """keys, score, matches: N scores 0, a column with two gaps is skipped and changes no state; matches are equal letters but N and gaps.

    A chunk's score supposes that no gap is open before it; where one is and the chunk's
    first counted column is gapped, that column goes on.
    """
    made = chunks.select(*keys, "chunk", _affine_summary(match, mismatch, gap_open, gap_extend)("a", "b").alias("s")).select(*keys, "chunk", "s.*")
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.last(F.when(F.col("counted"), F.col("last")), ignorenulls=True).over(earlier)
    moved = made.withColumn("score", F.col("score") + F.when(open_ & F.col("counted") & F.col("first"), gap_extend - gap_open).otherwise(0))
    return moved.groupBy(*keys).agg(F.sum("score").alias("score"), F.sum("matches").alias("matches"))


# ---- sums of windows


def _window_summary(width: int) -> Callable[..., Column]:
    def parts(a: pa.Array, b: pa.Array, a_before: pa.Array, b_before: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (x, sizes), (y, _) = _matrix(a), _matrix(b)
        edge = (_matrix(a_before)[0][:, :1] == GAP) | (_matrix(b_before)[0][:, :1] == GAP)
        gapped = (x == GAP) | (y == GAP)
        goes_on = np.concatenate([edge, gapped[:, :-1]], axis=1)
        inside = np.arange(x.shape[1]) < sizes[:, None]
        cost = np.where(inside, np.where(gapped, np.where(goes_on, GAP_EXTEND, GAP_OPEN), _HOXD[x, y]), 0)
        own = np.where(inside, _HOXD[x, x], 0)
        begins = np.arange(0, x.shape[1], width)
        return np.add.reduceat(cost, begins, axis=1), np.add.reduceat(own, begins, axis=1), -(-sizes // width)

    @F.arrow_udf("array<struct<score: bigint, score_100: bigint>>")
    def summary(a: pa.Array, b: pa.Array, a_before: pa.Array, b_before: pa.Array) -> pa.Array:
        scores, own, counts = [], [], []
        for part in _in_parts(a, b, a_before, b_before):
            s, o, n = parts(*part)
            some = np.arange(s.shape[1]) < n[:, None]
            scores.append(s[some])
            own.append(o[some])
            counts.append(n)
        values = [pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (scores, own)]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else [0]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, names=["score", "score_100"]))

    return summary


def window_sums(chunks: DataFrame, width: int) -> DataFrame:
    """aln_id, row_idx, win, score, score_100 of chunks with the letters before them; ``width`` divides a chunk's."""
    made = chunks.select("aln_id", "row_idx", "chunk", F.posexplode(_window_summary(width)("a", "b", "a_before", "b_before")).alias("_i", "w"))
    return made.select("aln_id", "row_idx", (F.col("chunk").cast("long") * (CHUNK // width) + F.col("_i")).alias("win"), "w.score", "w.score_100")


def mean_scores(seqs: Column) -> Column:
    """The mean of the scores of a block's rows (a list of strings, the centre first) against its centre, as windows of them add up; null where no row has a column.

    Rows are looked at a stretch at a time, so a task holds one block's strings.
    """

    def score(a: np.ndarray, b: np.ndarray) -> int | None:
        n = min(len(a), -(-len(b) // CHUNK) * CHUNK)
        total, before = None, False
        for at in range(0, n, CHUNK * AT_ONCE):
            x = a[at : min(at + CHUNK * AT_ONCE, n)]
            y = b[at : at + len(x)]
            y = np.concatenate([y, np.zeros(len(x) - len(y), np.uint8)])
            gapped = (x == GAP) | (y == GAP)
            goes_on = np.concatenate([[before], gapped[:-1]])
            total = (total or 0) + int(np.where(gapped, np.where(goes_on, GAP_EXTEND, GAP_OPEN), _HOXD[x, y]).sum())
            before = gapped[-1]
        return total

    def mean(texts: list[str]) -> float | None:
        rows = [np.frombuffer((t or "").encode("ascii", "replace"), np.uint8) for t in texts]
        scores = [s for s in (score(rows[0], r) for r in rows) if s is not None]
        return sum(scores) / len(scores) if scores else None

    @F.arrow_udf("double")
    def means(seqs: pa.Array) -> pa.Array:
        return pa.array([mean(texts.as_py()) for texts in seqs], pa.float64())

    return means(seqs)
