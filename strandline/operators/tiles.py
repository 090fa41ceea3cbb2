"""All pairs of an alignment's rows by tiles: (row block, row block, stretch of columns).

A tile's rows meet in one group; numpy counts the equal columns of all its pairs at once, on
a matrix of letters, and only a number a pair leaves it.  Rows are repeated once for each
block of rows of their alignment, so a tile is bounded by two blocks and a chunk however
deep or long the alignment is.  Case is folded; a gap equals a gap; letters that are not
ASCII are one symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .columns import CHUNK

#: Rows of a block.
ROWS = 64


def _equal(letters: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many columns each of ``letters`` has alike with each of ``others``."""
    return np.stack([np.count_nonzero(row == others, axis=1) for row in letters])


def _counts(rows: pa.ListScalar, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal columns) of the pairs i < j of a tile."""
    flat = rows.values
    index = flat.field("row_idx").to_numpy()
    letters = np.stack([np.frombuffer(t.encode("ascii", "replace"), np.uint8) for t in flat.field("s").to_pylist()])
    left, right = (np.flatnonzero(index // ROWS == block) for block in (p, q))
    equal = _equal(letters[left], letters[right])
    i, j = np.nonzero(index[left][:, None] < index[right][None, :])
    return index[left][i], index[right][j], equal[i, j]


@F.arrow_udf(ArrayType(StructType([StructField(c, LongType()) for c in "ijn"])))
def _pairs(rows: pa.Array, p: pa.Array, q: pa.Array) -> pa.Array:
    out = [_counts(r, a, b) for r, a, b in zip(rows, p.to_pylist(), q.to_pylist())]
    offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in out])]).astype(np.int32)
    columns = [pa.array(np.concatenate([x[k] for x in out]) if out else [], pa.int64()) for k in range(3)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=["i", "j", "n"]))


def pair_identities(aln: DataFrame) -> DataFrame:
    """aln_id, i, j, identity: share of equal letters of every two rows (i < j) of an alignment; rows of other lengths are an error."""
    sizes = aln.groupBy("aln_id").agg(F.max(F.floor(F.col("row_idx") / ROWS)).alias("_last"), F.min(F.length("seq")).alias("_low"), F.max(F.length("seq")).alias("_total"))
    checked = sizes.withColumn("_total", F.when(F.col("_low") == F.col("_total"), F.col("_total")).otherwise(F.raise_error(F.lit("sequences differ in length"))))
    parts = F.regexp_extract_all(F.lower("seq"), F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    cut = aln.join(checked.select("aln_id", "_last", "_total"), "aln_id").where("_total > 0").select("aln_id", "row_idx", "_last", "_total", F.posexplode(parts).alias("chunk", "s"))
    own = F.floor(F.col("row_idx") / ROWS)
    dealt = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).withColumn("p", F.least(own, "_other")).withColumn("q", F.greatest(own, "_other"))
    tiles = dealt.groupBy("aln_id", "_total", "chunk", "p", "q").agg(F.collect_list(F.struct("row_idx", "s")).alias("rows"))
    counted = tiles.select("aln_id", "_total", F.explode(_pairs("rows", "p", "q")).alias("c")).select("aln_id", "_total", "c.*")
    return counted.groupBy("aln_id", "i", "j").agg((F.sum("n").cast("double") / F.max("_total")).alias("identity"))
