"""Lengths, histograms and row-pair measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .columns import pair_chunks
from .summaries import affine_scores


def length_stats(seqs: DataFrame) -> DataFrame:
    n = F.length("seq")
    return seqs.agg(F.count("*").alias("size"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"), F.sum(n).alias("sum_len"), F.avg(n).alias("avg_len"))


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, n: equal widths from least to most; the last bin is closed; one value alone gets a range of one around it.

    Values are counted and stored once, then read for the range and for the bins.
    """
    v = F.col("v")
    counted = stored(values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("_n")), "values")
    span = counted.agg(F.min(v).alias("low"), F.max(v).alias("high")).select(
        F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    at = F.least(F.floor((v - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1))
    return counted.crossJoin(F.broadcast(span)).groupBy(at.cast("long").alias("bin")).agg(F.sum("_n").alias("n"))


def centre_pairs(aln: DataFrame, centre: int = 0) -> DataFrame:
    """aln_id, row_idx, a (the centre), b for every row; alignments without a centre are left out."""
    rows = aln.where(F.col("row_idx") == centre).select("aln_id", F.col("seq").alias("a"))
    return aln.withColumnRenamed("seq", "b").join(rows, "aln_id")


def match_table(aln: DataFrame) -> DataFrame:
    """aln_id, i, match_num, len_sequence (without gaps), ratio of every row against the centre."""
    matches = affine_scores(pair_chunks(aln), ["aln_id", "row_idx"], 0, 0, 0, 0).select("aln_id", F.col("row_idx").alias("i"), F.col("matches").alias("match_num"))
    sizes = aln.select("aln_id", F.col("row_idx").alias("i"), F.length(F.replace("seq", F.lit("-"), F.lit(""))).cast("long").alias("len_sequence"))
    return matches.join(sizes, ["aln_id", "i"]).withColumn("ratio", F.try_divide(F.col("match_num").cast("double"), F.col("len_sequence")))
