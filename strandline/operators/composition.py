"""Column composition and sum-of-pairs scores of alignments.

Scores follow from each column's base counts, so work grows with rows times columns and
not with pairs of rows.  Pair classes: equal bases match, different bases mismatch, a
base and a gap are ``gap1`` as N and a gap are, and N-N, N-base and gap-gap are ``gap2``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import ship
from .columns import column_keys
from .letters import by_stretch
from .restoration import GIVEN as LETTERS
from .restoration import code_points, single_letters
from .rope import WIDTH

#: Letters of a sequence that are cut at once: whole chunks.
GIVEN = LETTERS // WIDTH * WIDTH
SYMBOLS = {"a": "A", "c": "C", "g": "G", "t": "T", "n": "N", "gap": "-"}


def composition(cells: DataFrame) -> DataFrame:
    """aln_id, pos, a, c, g, t, n, gap: cells of a column are in one chunk, so no exchange is needed after theirs."""
    return cells.groupBy(*column_keys(cells)).agg(*(F.count_if(F.col("base") == s).alias(k) for k, s in SYMBOLS.items())).drop("chunk")


def column_counts(aln: DataFrame) -> DataFrame:
    """aln_id, pos, a, c, g, t, n, gap of alignments (aln_id, row_idx, seq): as :func:`composition` of their cells, counted on chunks as they pass."""

    def rows(aln_id: object, begin: int, stretch) -> list[np.ndarray]:
        return [begin + np.arange(stretch.width), *stretch.counts[:, : stretch.width]]

    return by_stretch(aln, ", ".join(f"{c} bigint" for c in ("pos", *SYMBOLS)), rows, "".join(SYMBOLS.values()))


def pair_classes(comp: DataFrame) -> DataFrame:
    """aln_id, pos and the number of row pairs of each class."""
    pairs = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    bases = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    match = pairs("a") + pairs("c") + pairs("g") + pairs("t")
    return comp.select(
        "aln_id", "pos",
        match.alias("n_match"),
        (F.expr("(a + c + g + t) * (a + c + g + t - 1) div 2") - match).alias("n_mismatch"),
        ((bases + F.col("n")) * F.col("gap")).alias("n_gap1"),
        (pairs("n") + bases * F.col("n") + pairs("gap")).alias("n_gap2"),
    )


def sp_scores(cells: DataFrame, match: int = 1, mismatch: int = -1, gap1: int = -2, gap2: int = 0) -> DataFrame:
    """aln_id, sp, avg_sp (over pairs of rows), scaled_sp (over columns) of cells, or of columns' counts; alignments with one row are left out."""
    classes = pair_classes(cells if "gap" in cells.columns else composition(cells))
    total = F.col("n_match") * match + F.col("n_mismatch") * mismatch + F.col("n_gap1") * gap1 + F.col("n_gap2") * gap2
    pairs = F.col("n_match") + F.col("n_mismatch") + F.col("n_gap1") + F.col("n_gap2")
    sums = classes.groupBy("aln_id").agg(F.sum(total).alias("sp"), F.max(pairs).alias("pairs"), F.count("*").alias("columns")).where("pairs > 0")
    average = F.col("sp").cast("double") / F.col("pairs")
    return sums.select("aln_id", "sp", average.alias("avg_sp"), (average / F.col("columns")).alias("scaled_sp"))


def occurrence_table(seqs: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, base, n_a .. n_gap: how often each symbol occurs up to and at each place of a sequence (keys, seq).

    A sequence is cut into chunks as it is read, each with the counts before it; chunks are
    dealt to tasks in the only exchange, and counted place by place in numpy on Arrow
    batches, some at a time.  No place is sorted or shuffled, and nothing is stored or joined.
    """
    ship(seqs.sparkSession)
    names, symbols, n_keys = [f"n_{k}" for k in SYMBOLS], [ord(s) for s in SYMBOLS.values()], len(keys)
    own = seqs.select(*keys).schema
    counts = [StructField(n, LongType()) for n in names]
    cut = StructType([*own, StructField("chunk", LongType()), StructField("piece", StringType()), *counts])
    schema = StructType([*own, StructField("pos", LongType()), StructField("base", StringType()), *counts])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(cut)
        for batch in batches:
            held, size = [], 0
            whole = lambda: pa.RecordBatch.from_arrays([
                *(batch.column(k).take(pa.array(np.repeat([h[0] for h in held], [len(h[2]) for h in held]))) for k in range(n_keys)),
                pa.array(np.concatenate([h[1] for h in held]), pa.int64()), pa.array([p for h in held for p in h[2]], pa.string()),
                *(pa.array(c, pa.int64()) for c in np.concatenate([h[3] for h in held], axis=1)),
            ], schema=kind)
            for row, seq in enumerate(batch.column(n_keys).to_pylist()):
                so_far = np.zeros((len(symbols), 1), np.int64)
                for low in range(0, len(seq or ""), GIVEN):
                    text = seq[low : low + GIVEN]
                    codes, begins = code_points(text), np.arange(0, len(text), WIDTH)
                    found = np.stack([np.add.reduceat(codes == s, begins, dtype=np.int64) for s in symbols])
                    held.append((row, (low + begins) // WIDTH, [text[i : i + WIDTH] for i in begins], so_far + np.cumsum(found, axis=1) - found))
                    so_far, size = so_far + found.sum(axis=1, keepdims=True), size + len(text)
                    if size >= GIVEN:
                        yield whole()
                        held, size = [], 0
            if held:
                yield whole()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                pieces = part.column(n_keys + 1).to_pylist()
                codes, sizes = code_points("".join(pieces)), np.array([len(p) for p in pieces])
                begins, row = np.cumsum(sizes) - sizes, pa.array(np.repeat(np.arange(len(pieces)), sizes))
                pos = np.repeat(part.column(n_keys).to_numpy() * WIDTH - begins, sizes) + np.arange(len(codes))
                counts = []
                for k, s in enumerate(symbols):
                    hit = codes == s
                    sums = np.cumsum(hit)
                    counts.append(sums + np.repeat(part.column(n_keys + 2 + k).to_numpy() - sums[begins] + hit[begins], sizes))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(row) for k in range(n_keys)), pa.array(pos), single_letters(codes), *map(pa.array, counts)], schema=kind)

    chunks = seqs.select(*keys, "seq").mapInArrow(chunked, cut)
    return chunks.repartition(*keys, "chunk").mapInArrow(placed, schema)
