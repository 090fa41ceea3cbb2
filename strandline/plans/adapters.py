"""Sequence and alignment views of the ``documents`` table, which has no nucleotides.

``seqs``: a text's ASCII letters, mapped to A, C, G, T, N and the gap.  ``aln``: each
text's whole sequence laid out in eight rows of equal width, the last padded with gaps;
row 0 is the centre.  ``cells``: one row a base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 8
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTANACGTAC-GTACG"

#: The same views for DuckDB, as common table expressions.
SEQS_SQL = f"""seqs AS (SELECT doc_id AS seq_idx, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents)"""
ALN_SQL = f"""{SEQS_SQL},
aln AS (SELECT seq_idx AS aln_id, r AS row_idx, rpad(substr(seq, r * w + 1, w), CAST(w AS INT), '-') AS seq
  FROM (SELECT seq_idx, seq, (length(seq) + {ROWS - 1}) // {ROWS} AS w, unnest(range({ROWS})) AS r FROM seqs WHERE length(seq) > 0))"""
CELLS_SQL = f"""{ALN_SQL},
cells AS (SELECT aln_id, row_idx, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos, unnest(string_split(seq, '')) AS base FROM aln)"""


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx, name, seq."""
    letters = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("seq_idx"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("name"), F.translate(letters, LETTERS, BASES).alias("seq"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx and the text's upper-case ASCII letters."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("seq_idx"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("seq"))


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aln_id, row_idx, seq."""
    laid = seqs(spark, sf_dir).where("length(seq) > 0").withColumn("w", F.expr(f"(length(seq) + {ROWS - 1}) div {ROWS}"))
    rows = laid.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(ROWS - 1))))
    return rows.select(F.col("seq_idx").alias("aln_id"), F.col("r").cast("long").alias("row_idx"), F.expr("rpad(substr(seq, cast(r * w + 1 as int), cast(w as int)), cast(w as int), '-')").alias("seq"))


def aln_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aln_id, seqs: the rows of each alignment of :func:`aln` as a list."""
    laid = seqs(spark, sf_dir).where("length(seq) > 0").withColumn("w", F.expr(f"cast((length(seq) + {ROWS - 1}) div {ROWS} as int)"))
    return laid.select(F.col("seq_idx").alias("aln_id"), F.expr(f"transform(sequence(0, {ROWS - 1}), r -> rpad(substr(seq, r * w + 1, w), w, '-'))").alias("seqs"))
