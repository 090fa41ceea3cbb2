"""Registered queries of the data sources, the ordered writer and checks by file, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import rope, runs
from ..sources import datasource, formats, text
from ..storage import fresh_path
from .adapters import ALN_SQL, SEQS_SQL, aln, seqs
from .queries import NAMED_SQL, _as_lines, _maf_text, _named
from .registry import query

#: Bytes of a reader's partition in these queries.
RANGE = 1 << 20


def _written(rows: DataFrame, order: list[str], extension: str) -> str:
    path = fresh_path(rows.sparkSession, extension)
    datasource.write_ordered(rows, path, order, extension=extension)
    return path


@query(f"WITH {SEQS_SQL} SELECT row_number() OVER (ORDER BY seq_idx) - 1 AS seq_idx, 's' || CAST(seq_idx AS VARCHAR) AS name, upper(seq) AS seq FROM seqs")
def fasta_source(spark, sf_dir):
    """Wrapped FASTA as an ordered set of files, read by byte ranges and numbered over the set."""
    path = _written(formats.render_fasta(seqs(spark, sf_dir), width=60), ["seq_idx"], "fa")
    records = spark.read.format("strandline-fasta").options(bytes=str(RANGE), upper="true").load(path)
    return datasource.number_records(records, whole_set=True).select("seq_idx", "name", "seq")


@query(f"WITH {SEQS_SQL} SELECT 's' || CAST(seq_idx AS VARCHAR) AS name FROM seqs WHERE CAST(seq_idx AS VARCHAR) LIKE '1%'")
def fasta_source_names(spark, sf_dir):
    """Names only, chosen by a filter that the reader takes over; bodies are not decoded."""
    path = _written(formats.render_fasta(seqs(spark, sf_dir), width=60), ["seq_idx"], "fa")
    return spark.read.format("strandline-fasta").schema("name string").option("bytes", str(RANGE)).load(path).where(F.col("name").startswith("s1"))


@query(f"WITH {NAMED_SQL} SELECT row_number() OVER (ORDER BY aln_id, row_idx) - 1 AS read_idx, 'read-' || name AS name, seq, length(seq) AS length FROM nm")
def fastq_source(spark, sf_dir):
    """FASTQ files read by byte ranges; qualities are full of header marks."""
    rows = _named(spark, sf_dir)
    body = F.concat_ws("\n", F.concat(F.lit("@read "), "name"), "seq", F.lit("+"), F.repeat(F.lit("@"), F.length("seq")))
    path = _written(rows.select("aln_id", "row_idx", body.alias("text")), ["aln_id", "row_idx"], "fq")
    records = spark.read.format("strandline-fastq").options(bytes=str(RANGE), dashes="true").load(path)
    return datasource.number_records(records, whole_set=True).select(F.col("seq_idx").alias("read_idx"), "name", "seq", F.length("quality").cast("long").alias("length"))


@query(f"WITH {ALN_SQL} SELECT row_number() OVER (ORDER BY aln_id, row_idx) - 1 AS seq_idx, seq FROM aln")
def wrapped_insertion_files(spark, sf_dir):
    """Gaps put back into their rows, wrapped and written as one ordered set of files, in one pass."""
    rows = aln(spark, sf_dir)
    whole = runs.insert_runs(rows.withColumn("seq", S.strip_gaps(F.col("seq"))), runs.symbol_runs(rows, "-"), "-")
    named = whole.select(F.struct("aln_id", "row_idx").alias("seq_idx"), F.concat_ws("_", "aln_id", "row_idx").alias("name"), "seq")
    path = _written(formats.render_fasta(named, width=70), ["seq_idx"], "fa")
    records = spark.read.format("strandline-fasta").option("bytes", str(RANGE)).load(path)
    return datasource.number_records(records, whole_set=True).select("seq_idx", "seq")


@query(f"WITH {NAMED_SQL} SELECT row_number() OVER (ORDER BY aln_id, row_idx) - 1 AS ord, name, 2 * row_idx AS start, length(replace(seq, '-', '')) AS len, '+' AS strand, length(seq) + 100 AS src_size, seq FROM nm")
def maf_files(spark, sf_dir):
    """MAF blocks as an ordered set of files, their rows numbered over the set by files, splits and lines."""
    path = _written(_maf_text(spark, sf_dir), ["aln_id"], "maf")
    rows = formats.parse_maf(text.read_lines(spark, path))
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = files.select("file", F.expr("coalesce(sum(n) over (order by file rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    blocks = rows.groupBy("file", "block_id").agg(F.count("*").alias("n"))
    inside = blocks.select("file", "block_id", F.expr("coalesce(sum(n) over (partition by file order by block_id rows between unbounded preceding and 1 preceding), 0)").alias("inside"))
    placed = rows.join(before, "file").join(inside, ["file", "block_id"])
    return placed.select((F.col("before") + F.col("inside") + F.col("row_ord")).alias("ord"), "name", "start", "len", "strand", "src_size", "seq")


@query(f"WITH {SEQS_SQL} SELECT 's' || CAST(seq_idx AS VARCHAR) AS name, seq FROM seqs")
def rope_files(spark, sf_dir):
    """Unknown bases put back chunk by chunk and written as wrapped lines; no sequence is joined before it is read again."""
    rows, keys = seqs(spark, sf_dir), ("seq_idx",)
    back = runs.symbol_runs(rows, "N", keys).select("seq_idx", F.col("idx").alias("start"), F.lit(0).cast("long").alias("len"), F.repeat(F.lit("N"), F.col("number").cast("int")).alias("str_value"))
    whole = rope.edited(rope.to_rope(rows.withColumn("seq", S.strip_n(F.col("seq"))), keys), back, keys)
    path = _written(rope.wrapped(whole, rows, keys, 70), ["seq_idx", "chunk"], "fa")
    return spark.read.format("strandline-fasta").option("bytes", str(RANGE)).load(path).select("name", "seq")


# ---- checks by file


def _fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alignment as the lines of a FASTA file; rows are named r0 to r7."""
    rows = aln(spark, sf_dir).select(F.struct("aln_id", "row_idx").alias("seq_idx"), F.concat(F.lit("r"), F.col("row_idx").cast("string")).alias("name"), "seq")
    return _as_lines(formats.render_fasta(rows, width=60).select("seq_idx.*", "text"), "aln_id", "row_idx")


@query(f"WITH {ALN_SQL} SELECT CAST(aln_id AS VARCHAR) AS file, 'r' || CAST(row_idx AS VARCHAR) AS name, seq FROM aln WHERE row_idx IN (0, 5)")
def fasta_two_named(spark, sf_dir):
    """Two named rows of each file, which must be there and equally long."""
    return formats.parse_fasta_named(_fasta_lines(spark, sf_dir), ["r0", "r5"]).select("file", "name", "seq")


@query(f"WITH {ALN_SQL} SELECT CAST(aln_id AS VARCHAR) AS file, row_idx AS seq_idx, 'r' || CAST(row_idx AS VARCHAR) AS name, seq FROM aln")
def fasta_checked(spark, sf_dir):
    """All rows of each file, which must be an alignment."""
    return formats.require_alignment(formats.parse_fasta(_fasta_lines(spark, sf_dir)))


@query(f"WITH {ALN_SQL} SELECT CAST(aln_id AS VARCHAR) AS file, 'r7' AS name, string_agg(seq, '' ORDER BY row_idx) AS seq FROM aln GROUP BY aln_id")
def fasta_concatenated(spark, sf_dir):
    """All records of each file as one; the last name stays."""
    return formats.concatenated(formats.parse_fasta(_fasta_lines(spark, sf_dir)))


@query(f"""WITH {SEQS_SQL}, f AS (SELECT CAST(seq_idx // 3 AS VARCHAR) AS file, count(*) AS n, min(length(seq)) AS low, max(length(seq)) AS high FROM seqs GROUP BY 1)
SELECT file, CASE WHEN n < 2 THEN 'an alignment needs two sequences' WHEN low <> high THEN 'sequences differ in length' END AS problem FROM f""")
def fasta_problems(spark, sf_dir):
    """What keeps files of three sequences each from being alignments."""
    lines = _as_lines(formats.render_fasta(seqs(spark, sf_dir)).withColumn("f", F.expr("seq_idx div 3")), "f", "seq_idx")
    return formats.problems(formats.parse_fasta(lines))
