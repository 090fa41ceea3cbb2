"""Alignments as cells, dealt to tasks by stretches of columns.

Rows are cut into chunks of ``CHUNK`` columns while they are strings, chunks of one stretch
meet by (aln_id, chunk), and only then become a row a cell.  What is shuffled is compact, a
long alignment is spread over many tasks, and what is grouped or ordered by column inside a
chunk needs no further exchange.  A chunk of a pair carries the letters before it, so gap
states need no window either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1000


def _parts(seq: str = "seq") -> Column:
    return F.regexp_extract_all(seq, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))


def _pos() -> Column:
    return (F.col("chunk").cast("long") * CHUNK + F.col("_i")).alias("pos")


def stretches(alignment: DataFrame, *keys: str) -> DataFrame:
    """keys, chunk, piece: rows as chunks, those of one stretch of columns in one task."""
    keys = keys or ("aln_id", "row_idx")
    return alignment.select(*keys, F.posexplode(_parts()).alias("chunk", "piece")).repartition("aln_id", "chunk")


def cells(alignment: DataFrame, *keys: str) -> DataFrame:
    """One row a base: keys, pos, base; of alignments also chunk."""
    if keys and "aln_id" not in keys:
        return alignment.select(*keys, F.posexplode(_parts()).alias("chunk", "_s")).select(*keys, "chunk", F.posexplode(F.split("_s", "")).alias("_i", "base")).select(*keys, _pos(), "base")
    keys = keys or ("aln_id", "row_idx")
    return stretches(alignment, *keys).select(*keys, "chunk", F.posexplode(F.split("piece", "")).alias("_i", "base")).select(*keys, "chunk", _pos(), "base")


def column_keys(cells: DataFrame) -> list[str]:
    return ["aln_id", *(c for c in ("chunk",) if c in cells.columns), "pos"]


def pair_chunks(aln: DataFrame, centre: int = 0) -> DataFrame:
    """aln_id, row_idx, chunk, a, b, a_before, b_before: chunks of the centre (a) and of each row (b), itself included.

    The letters before a chunk are a space for the first.
    """
    parts = F.transform(_parts(), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    whole = aln.select("aln_id", "row_idx", parts.alias("_p"))
    before = F.transform("_p", lambda p: F.struct(p["s"].alias("s"), F.when(p["i"] == 0, F.lit(" ")).otherwise(F.right(F.get("_p", p["i"] - 1)["s"], F.lit(1))).alias("before")))
    chunks = whole.select("aln_id", "row_idx", F.posexplode(before).alias("chunk", "_c")).select("aln_id", "row_idx", "chunk", F.col("_c.s").alias("b"), F.col("_c.before").alias("b_before"))
    mid = chunks.where(F.col("row_idx") == centre).select("aln_id", "chunk", F.col("b").alias("a"), F.col("b_before").alias("a_before"))
    return chunks.join(mid, ["aln_id", "chunk"])


def pair_cells(aln: DataFrame, centre: int = 0) -> DataFrame:
    """aln_id, row_idx, chunk, pos, x, y: the columns of the centre (x) and each row (y), itself included."""
    letters = lambda c: F.split(F.col(c), "")
    zipped = F.arrays_zip(letters("a").alias("x"), letters("b").alias("y"))
    return pair_chunks(aln, centre).select("aln_id", "row_idx", "chunk", F.posexplode(zipped).alias("_i", "p")).select("aln_id", "row_idx", "chunk", _pos(), "p.x", "p.y")
