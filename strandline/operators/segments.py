"""Ungapped segments, exact-match blocks and orientation of pair blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import INVERSION
from ..session import ship
from ..storage import stored
from . import columns
from .columns import column_keys
from .letters import AT_ONCE, GAP, Stretch, by_stretch, matrix
from .restoration import code_points
from .runs import offsets_at, restore_unknown
from .summaries import best_segments, pair_parts


_RUNS = "struct<s1: array<int>, s2: array<int>, e1: array<int>, e2: array<int>, n1: int, n2: int, head: boolean, tail: boolean>"


def _chunk_runs(a: list[str], b: list[str]) -> pa.Array:
    """For each chunk of a pair: its runs of columns without a gap in residues of both from its start, its residues, and whether a run begins with it and ends with it."""
    (x, sizes), (y, _) = matrix(a), matrix(b)
    inside = np.arange(x.shape[1]) < sizes[:, None]
    in1, in2 = inside & (x != GAP), inside & (y != GAP)
    n1, n2 = np.cumsum(in1, axis=1), np.cumsum(in2, axis=1)
    on = np.pad((in1 & in2).astype(np.int8), ((0, 0), (1, 1)))
    edges = np.diff(on, axis=1)
    (row, first), (_, last) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(a)))]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(n[row, at] - 1, pa.int32())) for n, at in ((n1, first), (n2, first), (n1, last - 1), (n2, last - 1))]
    tail = on[np.arange(len(a)), sizes] == 1
    names = ["s1", "s2", "e1", "e2", "n1", "n2", "head", "tail"]
    return pa.StructArray.from_arrays([*lists, pa.array(n1[:, -1], pa.int32()), pa.array(n2[:, -1], pa.int32()), pa.array(on[:, 1] == 1), pa.array(tail)], names=names)


def _runs_inside(a: str, b: str) -> Column:
    @F.arrow_udf(_RUNS)
    def found(a: pa.Array, b: pa.Array) -> pa.Array:
        parts = [_chunk_runs(a.slice(i, AT_ONCE).to_pylist(), b.slice(i, AT_ONCE).to_pylist()) for i in range(0, len(a), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else _chunk_runs([], [])

    return found(a, b)


def pair_segments(chunks: DataFrame) -> DataFrame:
    """aln_id, row_idx, s1, s2, e1, e2, total (the residues of the whole row) of runs of columns without a gap.

    A run that goes on over a chunk's end is given by the chunk where it ends, with the start
    that the chunk where it begins hands on; windows go over one row a chunk.
    """
    ship(chunks.sparkSession)
    pair = Window.partitionBy("aln_id", "row_idx")
    order = pair.orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    made = chunks.select("aln_id", "row_idx", "chunk", _runs_inside("a", "b").alias("r")).select("aln_id", "row_idx", "chunk", "r.*")
    placed = made.select(
        "*",
        F.coalesce(F.sum("n1").over(before), F.lit(0)).alias("o1"), F.coalesce(F.sum("n2").over(before), F.lit(0)).alias("o2"), F.sum("n2").over(pair).alias("total"),
        (F.col("head") & F.coalesce(F.lag("tail").over(order), F.lit(False))).alias("from_before"), (F.col("tail") & F.coalesce(F.lead("head").over(order), F.lit(False))).alias("goes_on"),
    )
    at_end = F.struct((F.element_at("s1", -1) + F.col("o1")).alias("s1"), (F.element_at("s2", -1) + F.col("o2")).alias("s2"))
    own_start = F.when(F.col("tail") & ~(F.col("from_before") & (F.size("s1") == 1)), at_end)
    handed = placed.withColumn("since", F.last(own_start, ignorenulls=True).over(before))
    each = handed.select("aln_id", "row_idx", "o1", "o2", "total", "from_before", "goes_on", "since", F.size("s1").alias("k"), F.posexplode(F.arrays_zip("s1", "s2", "e1", "e2")).alias("i", "r")).where("not (goes_on and i = k - 1)")
    start = lambda c, o: F.when(F.col("from_before") & (F.col("i") == 0), F.col(f"since.{c}")).otherwise(F.col(f"r.{c}") + F.col(o))
    return each.select("aln_id", "row_idx", start("s1", "o1").alias("s1"), start("s2", "o2").alias("s2"), (F.col("r.e1") + F.col("o1")).alias("e1"), (F.col("r.e2") + F.col("o2")).alias("e2"), "total")


def _merged_segments(spans: DataFrame, tolerance: int) -> DataFrame:
    order = Window.partitionBy("aln_id", "row_idx").orderBy("s1")
    apart = (F.col("s1") - F.lag("e1").over(order) - 1 >= tolerance) | (F.col("s2") - F.lag("e2").over(order) - 1 >= tolerance)
    group = F.sum(F.coalesce(apart.cast("long"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("island", group).groupBy("aln_id", "row_idx", "island").agg(F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.max("e1").alias("e1"), F.max("e2").alias("e2"))


def ungapped_segments(cells: DataFrame, tolerance: int = 0) -> DataFrame:
    """aln_id, row_idx, s1, s2, e1, e2 (inclusive) of runs of columns without a gap.

    Neighbouring runs are merged where fewer than ``tolerance`` residues of either row
    lie between them; ends are always columns without a gap.  ``cells`` are chunks of pairs,
    whose runs are found as strings in numpy, or pair cells: runs and residues are counted
    inside chunks, and then one row a run and chunk is put together over a pair.
    """
    if "a" in cells.columns:
        spans = pair_segments(cells)
        return (_merged_segments(spans, tolerance) if tolerance > 0 else spans).select("aln_id", "row_idx", "s1", "s2", "e1", "e2")
    inside = Window.partitionBy("aln_id", "row_idx", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    on = (F.col("x") != "-") & (F.col("y") != "-")
    placed = cells.select(
        "aln_id", "row_idx", "chunk", "pos", on.alias("on"),
        F.sum((~on).cast("long")).over(inside).alias("island"),
        F.sum((F.col("x") != "-").cast("long")).over(inside).alias("n1"),
        F.sum((F.col("y") != "-").cast("long")).over(inside).alias("n2"),
    )
    kept = lambda c, f: f(F.when(F.col("on"), F.col(c)))
    runs = placed.groupBy("aln_id", "row_idx", "chunk", "island").agg(kept("pos", F.min).alias("start"), kept("pos", F.max).alias("stop"), kept("n1", F.min).alias("s1"), kept("n2", F.min).alias("s2"), kept("n1", F.max).alias("e1"), kept("n2", F.max).alias("e2"), F.max("n1").alias("t1"), F.max("n2").alias("t2"))
    pair = Window.partitionBy("aln_id", "row_idx").orderBy("chunk", "island")
    before = pair.rowsBetween(Window.unboundedPreceding, -1)
    last = F.lead("chunk").over(pair).isNull() | (F.lead("chunk").over(pair) != F.col("chunk"))
    ended = runs.withColumn("u1", F.when(last, F.col("t1")).otherwise(0)).withColumn("u2", F.when(last, F.col("t2")).otherwise(0))
    moved = ended.withColumn("o1", F.coalesce(F.sum("u1").over(before), F.lit(0)) - 1).withColumn("o2", F.coalesce(F.sum("u2").over(before), F.lit(0)) - 1).where("start is not null")
    order = Window.partitionBy("aln_id", "row_idx").orderBy("start")
    joined = (F.lag("stop").over(order) == F.col("start") - 1).cast("long")
    group = F.sum(1 - F.coalesce(joined, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = moved.withColumn("group", group).groupBy("aln_id", "row_idx", "group").agg(F.min(F.col("s1") + F.col("o1")).alias("s1"), F.min(F.col("s2") + F.col("o2")).alias("s2"), F.max(F.col("e1") + F.col("o1")).alias("e1"), F.max(F.col("e2") + F.col("o2")).alias("e2"))
    if tolerance > 0:
        spans = _merged_segments(spans, tolerance)
    return spans.select("aln_id", "row_idx", "s1", "s2", "e1", "e2")


def _same_runs(aln_id: object, begin: int, stretch: Stretch) -> list[np.ndarray]:
    """First and last columns of a stretch's runs of columns with one letter that is no gap."""
    low = stretch.low[: stretch.width]
    same = np.concatenate([[0], (low == stretch.high[: stretch.width]) & (low != GAP), [0]]).astype(np.int8)
    edges = np.diff(same)
    return [begin + np.flatnonzero(edges == 1), begin + np.flatnonzero(edges == -1) - 1]


def exact_match_blocks(cells: DataFrame, least: int = 1) -> DataFrame:
    """aln_id, start, length of maximal column runs in which all rows have one base; runs at the end count.

    Runs are found inside chunks, and those that meet at a chunk's edge are put together.
    Of alignments (aln_id, row_idx, seq) runs are found on the chunks as they pass; cells may
    be given too.
    """
    if "seq" in cells.columns:
        runs = by_stretch(cells, "start bigint, stop bigint", _same_runs, "")
    else:
        keys = column_keys(cells)[:-1]
        columns = cells.groupBy(*keys, "pos").agg(((F.min("base") == F.max("base")) & (F.min("base") != "-")).alias("same"))
        inside = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        islands = columns.withColumn("island", F.sum((~F.col("same")).cast("long")).over(inside)).where("same")
        runs = islands.groupBy(*keys, "island").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    order = Window.partitionBy("aln_id").orderBy("start")
    joined = (F.lag("stop").over(order) == F.col("start") - 1).cast("long")
    group = F.sum(1 - F.coalesce(joined, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = runs.withColumn("group", group).groupBy("aln_id", "group").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start") + 1).alias("length"))
    return whole.where(F.col("length") >= least).select("aln_id", "start", "length")


def _gaps_of_chunks(aln: DataFrame, width: int) -> DataFrame:
    """aln_id, row_idx, chunk, size, gaps, mask: for each chunk of a row its letters, the gaps before it, and its own as bits."""
    kind = aln.select("aln_id", "row_idx", *(F.lit(None).cast(t).alias(c) for c, t in (("chunk", "long"), ("size", "int"), ("gaps", "long"), ("mask", "binary")))).schema

    def of(seq: str) -> list[tuple]:
        on, begins = code_points(seq) == GAP, np.arange(0, len(seq), width)
        own = np.add.reduceat(on, begins, dtype=np.int64) if len(begins) else begins
        return [(c, len(on[i : i + width]), n, np.packbits(on[i : i + width]).tobytes()) for c, (i, n) in enumerate(zip(begins.tolist(), (np.cumsum(own) - own).tolist()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        for batch in batches:
            each = [of(seq or "") for seq in batch.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            cut = [pa.array(c, f.type) for c, f in zip(zip(*(y for x in each for y in x)), list(names)[2:])]
            if cut:
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(2)), *cut], schema=names)

    return aln.select("aln_id", "row_idx", "seq").mapInArrow(run, kind)


def _bits_before(mask: str, at: str, width: int) -> Column:
    """How many of the first ``at`` bits are set."""

    @F.arrow_udf("bigint")
    def counted(mask: pa.Array, at: pa.Array) -> pa.Array:
        out = np.zeros(len(at), np.int64)
        for i in range(0, len(at), AT_ONCE):
            parts, n = mask.slice(i, AT_ONCE).to_pylist(), at.slice(i, AT_ONCE).to_numpy()
            bits = np.zeros((len(parts), -(-width // 8)), np.uint8)
            bits[np.arange(bits.shape[1]) < np.array([len(p) for p in parts])[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
            out[i : i + AT_ONCE] = (np.unpackbits(bits, axis=1) & (np.arange(bits.shape[1] * 8) < n[:, None])).sum(axis=1)
        return pa.array(out)

    return counted(mask, at)


def exact_match_rows(aln: DataFrame, least: int = 1) -> DataFrame:
    """aln_id, start, length, row_idx, row_start: exact-match runs with each row's own start, its bases before the run.

    A row's start is the run's less the gaps before it: those before its chunk, which are
    counted while rows are cut, and those in it, which come as bits.  No gap is a row, and
    nothing is sorted by row; a row that ends before a run has no start there.
    """
    ship(aln.sparkSession)
    width = columns.CHUNK
    chunk, at = F.floor(F.col("start") / width), F.col("start") - F.col("chunk") * width
    points = exact_match_blocks(aln, least).withColumn("chunk", chunk).withColumn("at", at)
    met = points.join(_gaps_of_chunks(aln, width), ["aln_id", "chunk"]).where("at < size")
    return met.select("aln_id", "start", "length", "row_idx", (F.col("start") - F.col("gaps") - _bits_before("mask", "at", width)).alias("row_start"))


def orientation_majority(blocks: DataFrame) -> DataFrame:
    """other, same_majority: whether strictly more than half of a pair's blocks lie on the same strand."""
    return blocks.groupBy("other").agg((F.count_if(F.col("a_fwd") == F.col("b_fwd")) * 2 > F.count("*")).alias("same_majority"))


def drawable_segments(blocks: DataFrame) -> DataFrame:
    """other, ord, x1, y1, x2, y2: end points of a pair's blocks, by strands and the majority's orientation."""
    whole = Window.partitionBy("other")
    majority = F.count_if(F.col("a_fwd") == F.col("b_fwd")).over(whole) * 2 > F.count("*").over(whole)
    same = F.col("a_fwd") == F.col("b_fwd")
    a, la, b, lb, total = (F.col(c) for c in ("a_start", "a_len", "b_start", "b_len", "b_total"))
    marked = blocks.withColumn("major", majority)
    y1 = F.when(same, b).when(F.col("major"), total - b).otherwise(b + lb)
    y2 = F.when(same, b + lb).when(F.col("major"), total - b - lb).otherwise(b)
    return marked.select("other", "ord", a.alias("x1"), y1.alias("y1"), (a + la).alias("x2"), y2.alias("y2"))


def _trimmed(aligned: DataFrame) -> DataFrame:
    """Adds ``m`` (score, start, stop), the first maximum-scoring segment of a and b; pairs without one are left out."""
    keys = ["aln_id", "row_idx"]
    best = best_segments(pair_parts(aligned, *keys), keys, *INVERSION).where("score is not null")
    return aligned.join(best.select(*keys, F.struct("score", "start", "stop").alias("m")), keys)


def inverted_blocks(aligned: DataFrame, least: int = 1) -> DataFrame:
    """aln_id, row_idx, a_start, a_len, b_start, b_len, score: where a row matches the reverse complement of another.

    ``aligned`` has aln_id, row_idx, a and b, b being the aligned reverse complement. Rows
    are trimmed to their first maximum-scoring segment; spans of fewer than ``least``
    columns between first and last are dropped. ``b_start`` counts on b's own strand.
    """
    return _inverted(_trimmed(aligned), least)


def _inverted(trimmed: DataFrame, least: int) -> DataFrame:
    found = trimmed.where(F.col("m.stop") - F.col("m.start") >= least)
    before = lambda c: F.length(F.replace(F.substring(c, F.lit(1), F.col("m.start").cast("int")), F.lit("-"), F.lit(""))).cast("long")
    inside = lambda c: F.length(F.replace(F.substring(c, (F.col("m.start") + 1).cast("int"), (F.col("m.stop") - F.col("m.start") + 1).cast("int")), F.lit("-"), F.lit(""))).cast("long")
    total = F.length(F.replace("b", F.lit("-"), F.lit(""))).cast("long")
    placed = found.select("aln_id", "row_idx", before("a").alias("a_start"), inside("a").alias("a_len"), before("b").alias("_b"), inside("b").alias("b_len"), total.alias("_n"), F.col("m.score").alias("score"))
    return placed.select("aln_id", "row_idx", "a_start", "a_len", (F.col("_n") - F.col("_b") - F.col("b_len")).alias("b_start"), "b_len", "score")


def side_blocks(pairs: DataFrame, n_runs: DataFrame, least: int = 1) -> DataFrame:
    """aln_id, row_idx, a_start, a_len, a, b_start, b_len, b: maximum-scoring parts of side blocks, with their unknown bases.

    ``pairs`` has aln_id, row_idx, a and b (a stretch of the centre aligned with the reverse
    complement of a stretch of the row, both without N) and the stretches a_start, a_end,
    b_start, b_end (half-open, in coordinates without N).  ``n_runs`` has the runs of
    centre (row 0) and rows.  Runs inside a stretch are put back into the alignment, those
    up to its start are added to it; then rows are trimmed as in :func:`inverted_blocks`.
    """
    block = F.struct("aln_id", "row_idx").alias("aln_id")
    both = pairs.select(block, F.explode(F.array(F.struct(F.lit(0).cast("long").alias("row_idx"), F.col("a").alias("seq")), F.struct(F.lit(1).cast("long").alias("row_idx"), F.col("b").alias("seq")))).alias("r")).select("aln_id", "r.*")
    centre, others = n_runs.where("row_idx = 0").drop("row_idx"), n_runs.where("row_idx > 0")
    in_a = pairs.join(centre, "aln_id").where("idx > a_start and idx < a_end").select(block, F.lit(0).cast("long").alias("row_idx"), (F.col("idx") - F.col("a_start")).alias("idx"), "number")
    in_b = pairs.join(others, ["aln_id", "row_idx"]).where("idx > b_start and idx < b_end").select(block, F.lit(1).cast("long").alias("row_idx"), (F.col("b_end") - F.col("idx")).alias("idx"), "number")
    restored = stored(restore_unknown(both, in_a.unionByName(in_b)), "side-blocks")
    rows = restored.groupBy("aln_id").agg(F.max(F.when(F.col("row_idx") == 0, F.col("seq"))).alias("a"), F.max(F.when(F.col("row_idx") == 1, F.col("seq"))).alias("b"))
    trimmed = stored(_trimmed(stored(rows.select("aln_id.*", "a", "b"), "side-rows")), "side-segments")
    place = _inverted(trimmed, least).drop("score").withColumnsRenamed({"a_start": "_a", "b_start": "_b"})
    cut = lambda c: F.expr(f"substr({c}, cast(m.start + 1 as int), cast(m.stop - m.start + 1 as int))").alias(c)
    shown = trimmed.select("aln_id", "row_idx", cut("a"), cut("b"))
    keys = ["aln_id", "row_idx"]
    before_a = offsets_at(pairs.select("aln_id", F.col("a_start").alias("start")).distinct(), centre, ("aln_id",)).withColumnsRenamed({"start": "a_start", "before": "_na"})
    before_b = offsets_at(pairs.select(*keys, F.col("b_start").alias("start")).distinct(), others).withColumnsRenamed({"start": "b_start", "before": "_nb"})
    found = place.join(shown, keys).join(pairs.select(*keys, "a_start", "b_start"), keys).join(before_a, ["aln_id", "a_start"]).join(before_b, [*keys, "b_start"])
    return found.select(*keys, (F.col("_a") + F.col("a_start") + F.col("_na")).alias("a_start"), "a_len", "a", (F.col("_b") + F.col("b_start") + F.col("_nb")).alias("b_start"), "b_len", "b")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, idx) with the intervals (keys, start, stop exclusive) that hold them, found by nested bins.

    Bins of level n are 2**n wide.  An interval lies in at most two bins of the level that is
    as wide as itself; a point lies in one bin of each level that any interval has.  So there
    are at most two rows an interval and ``levels`` rows a point, and what meets in a bin is
    no further apart than the interval is long.
    """
    n = F.col("stop") - F.col("start")
    level = F.when(n == 1, 0).otherwise(F.length(F.bin(n - 1)))
    shifted = lambda c: F.expr(f"shiftright({c}, _level)")
    i = intervals.where("stop > start").withColumn("_level", level.cast("int")).withColumn("_bin", F.explode(F.array_distinct(F.array(shifted("cast(start as bigint)"), shifted("cast(stop - 1 as bigint)")))))
    levels = sorted(r[0] for r in i.select("_level").distinct().collect())  # 63 at most
    if not levels:
        return points.join(intervals, keys).where("false")
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bin", shifted("cast(idx as bigint)"))
    return p.join(i, [*keys, "_level", "_bin"]).where("idx >= start and idx < stop").drop("_level", "_bin")


def free_intervals(totals: DataFrame, used: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys, start, len: maximal stretches of at least ``least`` positions that no used interval holds.

    ``totals`` has keys and total, the length of each sequence; ``used`` has keys, start and
    len, overlapping or not.  Intervals are ordered by start and compared with the furthest
    end so far; no position becomes a row.
    """
    both = used.where("len > 0").select(*keys, F.col("start").cast("long").alias("start"), (F.col("start") + F.col("len")).cast("long").alias("_stop")).unionByName(totals.select(*keys, F.col("total").cast("long").alias("start"), F.col("total").cast("long").alias("_stop")))
    earlier = Window.partitionBy(*keys).orderBy("start", "_stop").rowsBetween(Window.unboundedPreceding, -1)
    gaps = both.withColumn("_since", F.coalesce(F.max("_stop").over(earlier), F.lit(0)))
    return gaps.where(F.col("start") - F.col("_since") >= least).select(*keys, F.col("_since").alias("start"), (F.col("start") - F.col("_since")).alias("len"))
