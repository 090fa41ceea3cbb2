"""Rows of alignments as bit planes: 60 columns in five whole numbers.

A chunk's letters are five-bit codes, and each of its planes holds one bit of all codes.
Two rows differ where any of their planes do, so a pair of rows is compared with a few
operations on whole numbers for 60 columns, chunk by chunk: a long alignment is dealt to
many tasks, and only counts meet.  Case is folded; everything but letters, ``-``, ``*`` and
``.`` is one symbol.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, PLANES = 60, 5
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz-*.?"


def _plane(letters: Column, j: int) -> Column:
    bits = "".join(str(i >> j & 1) for i in range(1, len(_SYMBOLS) + 1))
    return F.conv(F.translate(letters, _SYMBOLS, bits), 2, 10).cast("long").alias(f"p{j}")


def chunk_planes(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, total, chunk, n, p0 .. p4: the planes of each chunk of ``seq``; total is the row's length, n the chunk's."""
    parts = F.regexp_extract_all(F.regexp_replace(F.lower("seq"), r"[^a-z\-*.]", "?"), F.lit("(?s).{1,%d}" % WIDTH), F.lit(0))
    cut = rows.select(*keys, F.length("seq").cast("long").alias("total"), F.posexplode(parts).alias("chunk", "_s"))
    return cut.select(*keys, "total", "chunk", F.length("_s").cast("long").alias("n"), *(_plane(F.col("_s"), j) for j in range(PLANES)))


def equal_columns(left: str, right: str) -> Column:
    """How many columns two joined chunks have alike; their planes have the prefixes ``left`` and ``right``."""
    apart = reduce(Column.bitwiseOR, (F.col(f"{left}p{j}").bitwiseXOR(F.col(f"{right}p{j}")) for j in range(PLANES)))
    return F.col(f"{left}n") - F.bit_count(apart)


def _named(chunks: DataFrame, prefix: str, row: str) -> DataFrame:
    return chunks.select("aln_id", "chunk", F.col("row_idx").alias(row), *(F.col(c).alias(prefix + c) for c in ("total", "n", *(f"p{j}" for j in range(PLANES)))))


def _identities(pairs: DataFrame, *keys: str) -> DataFrame:
    checked = F.when(F.col("a_total") != F.col("b_total"), F.raise_error(F.lit("sequences differ in length"))).otherwise(equal_columns("a_", "b_"))
    return pairs.groupBy("aln_id", *keys).agg((F.sum(checked).cast("double") / F.max("a_total")).alias("identity"))


def centre_identities(aln: DataFrame, centre: int = 0) -> DataFrame:
    """aln_id, row_idx, identity of every other row with the centre."""
    chunks = chunk_planes(aln, "aln_id", "row_idx")
    mid = _named(chunks.where(F.col("row_idx") == centre), "a_", "_centre").drop("_centre")
    return _identities(mid.join(_named(chunks.where(F.col("row_idx") != centre), "b_", "row_idx"), ["aln_id", "chunk"]), "row_idx")
