"""Affine block scores, scores of fixed windows, and blocks built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import column_keys
from .summaries import window_sums

WIDTH = 100


def window_scores(chunks: DataFrame) -> DataFrame:
    """aln_id, win, row_idx, score, score_100 (the centre against itself without gap costs) of each window of 100 columns; the last may be shorter.

    ``chunks`` are chunks of pairs.  A column costs its substitution score, or a gap that
    opens, or goes on from the column before; windows are summed inside chunks.
    """
    return window_sums(chunks, WIDTH).select("aln_id", "win", "row_idx", "score", "score_100")


def row_scores(scored: DataFrame) -> DataFrame:
    """aln_id, row_idx, score of whole rows, from their windows."""
    return scored.groupBy("aln_id", "row_idx").agg(F.sum("score").alias("score"))


def block_scores(scored: DataFrame) -> DataFrame:
    """aln_id, score: the mean of all rows' scores, the centre's own among them."""
    return row_scores(scored).groupBy("aln_id").agg(F.avg("score").alias("score"))


def choose_rows(windows: DataFrame, share: int = 60) -> DataFrame:
    """The largest sets of best rows whose mean reaches ``share`` per cent of the centre's score; ties go to the smaller row."""
    order = Window.partitionBy("aln_id", "win").orderBy(F.desc("score"), "row_idx").rowsBetween(Window.unboundedPreceding, 0)
    limit = F.expr(f"(score_100 * {share}) div 100")
    ranked = windows.withColumn("total", F.sum("score").over(order)).withColumn("k", F.count("*").over(order)).withColumn("lim", limit)
    whole = Window.partitionBy("aln_id", "win")
    kept = F.max(F.when(F.col("total") >= F.col("k") * F.col("lim"), F.col("k"))).over(whole)
    some = F.max("score").over(whole) >= F.col("lim")
    return ranked.withColumn("kept", kept).withColumn("some", some).where("some and k <= kept").select("aln_id", "win", "row_idx", "score", "score_100")


def merged_windows(chosen: DataFrame) -> DataFrame:
    """aln_id, first_win, n_win, rows, score, score_100: neighbouring windows with one set of rows, scores averaged."""
    sets = chosen.groupBy("aln_id", "win").agg(F.array_sort(F.collect_list("row_idx")).alias("ids"), F.avg("score").alias("score"), F.max("score_100").alias("score_100")).withColumn("rows", F.array_join("ids", ","))
    order = Window.partitionBy("aln_id").orderBy("win")
    new = (F.lag("win").over(order) != F.col("win") - 1) | (F.lag("rows").over(order) != F.col("rows"))
    island = F.sum(F.coalesce(new.cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    blocks = sets.withColumn("island", island).groupBy("aln_id", "island", "rows")
    return blocks.agg(F.min("win").alias("first_win"), F.count("*").alias("n_win"), F.avg("score").alias("score"), F.avg("score_100").alias("score_100")).drop("island")


def gap_columns(cells: DataFrame) -> DataFrame:
    """aln_id, columns, gap_columns: columns with at least one gap, of cells or of columns' counts."""
    if "gap" in cells.columns:
        return cells.groupBy("aln_id").agg(F.count("*").alias("columns"), F.count_if(F.col("gap") > 0).alias("gap_columns"))
    columns = cells.groupBy(*column_keys(cells)).agg(F.bool_or(F.col("base") == "-").alias("gap"))
    return columns.groupBy("aln_id").agg(F.count("*").alias("columns"), F.count_if("gap").alias("gap_columns"))


def filter_blocks(blocks: DataFrame, least_columns: int, least_rows: int, least_continuity: float) -> DataFrame:
    """Blocks (columns, rows, gap_columns) that are long, deep and continuous enough."""
    continuity = 100.0 - 100.0 * F.col("gap_columns") / F.col("columns")
    return blocks.withColumn("continuity", continuity).where((F.col("columns") >= least_columns) & (F.col("rows") >= least_rows) & (F.col("continuity") > least_continuity))
