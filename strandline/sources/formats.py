"""Readers and writers of sequence and alignment text formats.

Parsers take lines as :func:`strandline.sources.text.read_lines` gives them, writers
return an ordered table with a column ``text``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import encode, header, reverse_complement, strip_n
from ..operators.runs import with_runs
from ..session import ship
from .text import number, six_digits


def _joined(value: str = "line") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", value))), lambda x: x[value]), "")


# ---- FASTA


def parse_fasta(lines: DataFrame, upper: bool = False, dashes: bool = False) -> DataFrame:
    """file, seq_idx, name, seq: text before the first header is dropped, blank lines and outer spaces are ignored."""
    marked = number(lines, {"rec": F.col("line").startswith(">")}).where("rec > 0")
    body = F.when(~F.col("line").startswith(">"), F.trim("line")).otherwise("")
    names = F.max(F.when(F.col("line").startswith(">"), header(F.col("line"), dashes)))
    rows = marked.withColumn("body", body).groupBy("file", "rec").agg(names.alias("name"), _joined("body").alias("seq"))
    seq = F.upper("seq") if upper else F.col("seq")
    return rows.select("file", (F.col("rec") - 1).alias("seq_idx"), "name", seq.alias("seq"))


def problems(seqs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """file, problem: what keeps the records of a file from being an alignment (of ``names``, where given), null where nothing does."""
    found = F.count("*") if names is None else F.count_distinct(F.when(F.col("name").isin(names), F.col("name")))
    n = F.length("seq") if names is None else F.when(F.col("name").isin(names), F.length("seq"))
    few = F.lit("an alignment needs two sequences" if names is None else "a named sequence is missing")
    checked = seqs.groupBy("file").agg(found.alias("_n"), F.min(n).alias("_low"), F.max(n).alias("_high"))
    least = 2 if names is None else len(set(names))
    return checked.select("file", F.when(F.col("_n") < least, few).when(F.col("_low") != F.col("_high"), F.lit("sequences differ in length")).alias("problem"))


def _without_problems(seqs: DataFrame, found: DataFrame) -> DataFrame:
    """``seqs``; reading a row of a file with a problem is an error."""
    ok = F.when(F.col("problem").isNull(), F.col("seq")).otherwise(F.raise_error(F.concat_ws(": ", "file", "problem")))
    return seqs.join(found, "file").withColumn("seq", ok).select(*seqs.columns)


def parse_fasta_named(lines: DataFrame, names: list[str], upper: bool = True) -> DataFrame:
    """The named sequences of each file; reading is an error where a file lacks one or lengths differ."""
    seqs = parse_fasta(lines, upper)
    return _without_problems(seqs, problems(seqs, names)).where(F.col("name").isin(names))


def require_alignment(seqs: DataFrame) -> DataFrame:
    """``seqs``; reading is an error where a file has fewer than two sequences, or not all of one length."""
    return _without_problems(seqs, problems(seqs))


def concatenated(seqs: DataFrame) -> DataFrame:
    """name (of the last record), seq (all records in order) of each file."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_idx", "seq"))), lambda x: x["seq"]), "")
    return seqs.groupBy("file").agg(F.max_by("name", "seq_idx").alias("name"), parts.alias("seq"))


def render_fasta(seqs: DataFrame, mark: str = ">", width: int | None = None, sign: str | None = None) -> DataFrame:
    """seq_idx, text: one record a row; ``width`` wraps lines, ``sign`` names a column that is appended in brackets."""
    body = F.regexp_replace("seq", "(.{%d})(?!$)" % width, "$1\n") if width else F.col("seq")
    head = F.concat(F.lit(mark), F.col("name"), *([F.lit("("), F.col(sign), F.lit(")")] if sign else []))
    return seqs.select("seq_idx", F.concat(head, F.lit("\n"), body).alias("text"))


def coded_records(seqs: DataFrame, keys: tuple[str, ...] = ("file", "seq_idx")) -> DataFrame:
    """Records (keys, name, seq) as codes without N, with length, all_length (N included) and n_runs."""
    core = strip_n(F.upper("seq"))
    rows = with_runs(seqs.withColumn("seq", F.upper("seq")), "N", keys)
    return rows.select(*keys, "name", encode(core).alias("codes"), F.length(core).cast("long").alias("length"), F.length("seq").cast("long").alias("all_length"), "n_runs")


# ---- FASTQ


def parse_fastq(lines: DataFrame) -> DataFrame:
    """file, read_idx, name, seq (without N), seq_rc, length, all_length; records have four lines."""
    numbered = number(lines, {}).withColumn("read_idx", F.floor(F.col("line_no") / 4)).withColumn("part", F.col("line_no") % 4)
    pick = lambda k: F.max(F.when(F.col("part") == k, F.col("line")))
    rows = numbered.groupBy("file", "read_idx").agg(pick(0).alias("name"), pick(1).alias("raw")).where("raw is not null")
    core = rows.withColumn("seq", strip_n(F.col("raw")))
    return core.select("file", "read_idx", header(F.col("name"), dashes=True).alias("name"), "seq", reverse_complement(F.col("seq")).alias("seq_rc"), F.length("seq").cast("long").alias("length"), F.length("raw").cast("long").alias("all_length"), "raw")


# ---- Clustal


def parse_clustal(lines: DataFrame, legacy: bool = False) -> DataFrame:
    """file, seq_idx, name, seq: fragments joined by name, names in order of appearance.

    The header and conservation lines are dropped; ``legacy`` also drops every line with
    one of ``*:.`` in it, names with a dot included.
    """
    numbered = number(lines, {}).where((F.col("line_no") >= 2) & (F.trim("line") != ""))
    kept = numbered.where(~F.col("line").rlike("[*:.]")) if legacy else numbered.where(~F.col("line").rlike(r"^\s"))
    tokens = kept.select("file", "line_no", F.split("line", r"\s+").alias("t")).select("file", "line_no", F.get("t", F.lit(0)).alias("name"), F.get("t", F.lit(1)).alias("frag")).where("frag is not null")
    rows = tokens.groupBy("file", "name").agg(F.min("line_no").alias("first"), _joined("frag").alias("seq"))
    order = Window.partitionBy("file").orderBy("first")
    return rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("seq_idx"), "name", "seq")


# ---- XMFA


def parse_xmfa_head(lines: DataFrame) -> DataFrame:
    """file, id, name, length of the sequences that the head lists."""
    marked = number(lines.where(F.col("line").startswith("#")), {"id": F.col("line").rlike(r"^#+\s*Sequence\s*Index")}).where("id > 0")
    name = F.max(F.when(F.col("line").rlike("^#+SequenceHeader"), header(F.regexp_replace(F.col("line"), r"^#+SequenceHeader\s*>?", ""), dashes=True)))
    length = F.max(F.when(F.col("line").rlike("^#+SequenceLength"), F.regexp_extract("line", r"(\d+)\s*bp", 1).cast("long")))
    return marked.groupBy("file", "id").agg(name.alias("name"), length.alias("length"))


def parse_xmfa_blocks(lines: DataFrame) -> DataFrame:
    """file, block_id, row_ord, id, start, len, strand, seq; interval bounds are inclusive, starts stay as written.

    Lines are numbered without the head's, and those of a block then meet in one task, where its rows stay.
    """
    marked = number(lines.where(~F.col("line").startswith("#")), {"block_id": F.col("line").startswith("="), "row": F.col("line").startswith(">")}).where(~F.col("line").startswith("=")).repartition("file", "block_id")
    head = r"^>\s*(\d+):(\d+)-(\d+)\s+([+-])"
    body = F.when(~F.col("line").startswith(">"), F.trim("line")).otherwise("")
    part = lambda i: F.max(F.when(F.col("line").startswith(">"), F.regexp_extract("line", head, i)))
    rows = marked.where("row > 0").withColumn("body", body).groupBy("file", "block_id", "row").agg(part(1).cast("int").alias("id"), part(2).cast("long").alias("start"), part(3).cast("long").alias("stop"), part(4).alias("strand"), _joined("body").alias("seq"))
    order = Window.partitionBy("file", "block_id").orderBy("row")
    return rows.select("file", "block_id", (F.row_number().over(order) - 1).alias("row_ord"), "id", "start", (F.col("stop") - F.col("start") + 1).alias("len"), "strand", "seq")


# ---- MAF


def parse_maf(lines: DataFrame) -> DataFrame:
    """file, block_id, row_ord, name, start, len, strand, src_size, seq."""
    marked = number(lines, {"block_id": F.col("line").rlike(r"^a(\s|$)")}).where(F.col("line").rlike(r"^s\s") & (F.col("block_id") > 0))
    t = F.split(F.trim("line"), r"\s+")
    rows = marked.select("file", "block_id", "line_no", t.alias("t"))
    order = Window.partitionBy("file", "block_id").orderBy("line_no")
    at = lambda i, kind: F.get("t", F.lit(i)).cast(kind)
    return rows.select("file", (F.col("block_id") - 1).alias("block_id"), (F.row_number().over(order) - 1).alias("row_ord"), at(1, "string").alias("name"), at(2, "long").alias("start"), at(3, "long").alias("len"), at(4, "string").alias("strand"), at(5, "long").alias("src_size"), at(6, "string").alias("seq"))


def maf_pairs(rows: DataFrame, centre: str, other: str | None = None) -> DataFrame:
    """file, other, a_total, b_total, ord, a_start, a_len, a_fwd, b_start, b_len, b_fwd: the centre's rows against the others' of their blocks.

    Blocks without the centre give nothing; several rows of one name give all pairs.
    """
    a = rows.where(F.col("name") == centre).select("file", "block_id", F.col("src_size").alias("a_total"), F.col("start").alias("a_start"), F.col("len").alias("a_len"), (F.col("strand") == "+").alias("a_fwd"))
    b = rows.where(F.col("name") == other if other else F.col("name") != centre).select("file", "block_id", F.col("name").alias("other"), F.col("src_size").alias("b_total"), F.col("start").alias("b_start"), F.col("len").alias("b_len"), (F.col("strand") == "+").alias("b_fwd"))
    return a.join(b, ["file", "block_id"]).select("file", "other", "a_total", "b_total", F.col("block_id").alias("ord"), "a_start", "a_len", "a_fwd", "b_start", "b_len", "b_fwd")


def render_maf(rows: DataFrame, scores: DataFrame, keys: list[str], name_width: int = 20, number_width: int = 10) -> DataFrame:
    """keys, text: one block a row, ``a score=`` and an ``s`` line a sequence; six significant digits."""
    line = F.format_string(f"s %-{name_width}s %{number_width}d %{number_width}d %s %{number_width}d %s", "name", "start", "len", "strand", "src_size", "seq")
    blocks = rows.select(*keys, "row_ord", line.alias("line")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(F.lit("a score="), six_digits(F.col("score")))
    return blocks.join(scores, keys).select(*keys, F.concat(head, F.lit("\n"), F.col("body"), F.lit("\n")).alias("text"))


# ---- records of unknown-base runs


#: Lines of a run record that are put into one row.
TOGETHER = 1000


def render_run_records(seqs: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """seq_idx, text: name, run count and length without N, and the runs, of each sequence.

    ``seqs`` has seq_idx, name, seq, and an ordered array ``runs`` where there is no table of them.
    """
    seqs = seqs.select("seq_idx", "name", F.length(strip_n(F.col("seq"))).alias("_length"), *(["runs"] if runs is None else []))
    lines = F.transform("runs", lambda r: F.concat(r["idx"].cast("string"), F.lit(" "), r["number"].cast("string"), F.lit(" ")))
    head = F.concat(F.lit("> "), F.col("name"), F.lit("\n"), F.coalesce(F.size("runs"), F.lit(0)).cast("string"), F.lit(" "), F.col("_length").cast("string"))
    if runs is not None:
        seqs = seqs.join(runs.groupBy("seq_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "number"))).alias("runs")), "seq_idx", "left")
    return seqs.select("seq_idx", F.concat_ws("\n", head, F.when(F.size("runs") > 0, F.array_join(lines, "\n"))).alias("text"))


def render_runs(seqs: DataFrame, runs: DataFrame) -> DataFrame:
    """seq_idx, text: first the padded count (seq_idx -1), then the records."""
    return render_run_records(seqs, runs).union(seqs.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long"), F.rpad(F.col("n").cast("string"), 10, " ")))


def parse_runs(lines: DataFrame) -> DataFrame:
    """file, seq_idx, name, length, idx, number of every run; a sequence without runs has one row with null idx."""
    listed = parse_listed_runs(lines)
    return listed.select("file", "seq_idx", "name", "length", F.explode_outer("runs").alias("r")).select("file", "seq_idx", "name", "length", "r.idx", "r.number")


def _together(lines: DataFrame) -> DataFrame:
    """file, block, at, mark, lines: lines that follow each other in a partition and in their block, up to ``TOGETHER`` of one record; mark is 1 where a record begins with them, else 0."""
    ship(lines.sparkSession)
    most = TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file, block, at, line = batch.columns
            head = pc.fill_null(pc.starts_with(line, ">"), False).to_numpy(zero_copy_only=False)
            new = head.copy()
            new[0] = True
            for key in (file, block):
                new[1:] |= pc.fill_null(pc.not_equal(key.slice(1), key.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            new[1:] |= np.diff(at.to_numpy()) != 1
            place = np.arange(n)
            new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % most == 0
            begins = np.flatnonzero(new)
            first, ends = pa.array(begins), pa.array(np.append(begins, n), pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(first) for c in (file, block, at)), pa.array(head[begins].astype(np.int64)), pa.ListArray.from_arrays(ends, line)], names=["file", "block", "at", "mark", "lines"])

    return lines.select("file", F.col("block").cast("long").alias("block"), F.col("at").cast("long").alias("at"), "line").mapInArrow(run, "file string, block bigint, at bigint, mark bigint, lines array<string>")


def parse_listed_runs(lines: DataFrame) -> DataFrame:
    """file, seq_idx, name, length, runs (idx, number): the runs of a sequence as lists, in some rows where they are many.

    Lines are put together where they lie (:func:`_together`), and only these rows meet by
    block and by record.
    """
    pieces = _together(lines)
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum("mark").alias("_marks")).select("file", "block", F.coalesce(F.sum("_marks").over(before), F.lit(0)).alias("_marks"))
    placed = pieces.withColumn("rec", F.sum("mark").over(inside)).join(blocks, ["file", "block"]).withColumn("rec", F.col("rec") + F.col("_marks")).where("rec > 0")
    record = Window.partitionBy("file", "rec")
    start = F.coalesce(F.sum(F.size("lines")).over(record.orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = lambda line: F.split(F.trim(line), r"\s+")
    at = lambda line, i: F.get(words(line), F.lit(i)).cast("long")
    own = F.filter("lines", lambda line, i: (F.col("start") + i > 1) & (F.trim(line) != ""))
    second = F.when(F.col("start") < 2, F.get("lines", (1 - F.col("start")).cast("int")))
    known = placed.withColumn("start", start).select(
        "file", "rec", "start",
        F.max(F.when(F.col("start") == 0, header(F.get("lines", F.lit(0))))).over(record).alias("name"),
        F.max(F.try_element_at(words(second), F.lit(2)).try_cast("long")).over(record).alias("length"),
        F.transform(own, lambda line: F.struct(at(line, 0).alias("idx"), at(line, 1).alias("number"))).alias("runs"),
    )
    some = known.withColumn("_all", F.sum(F.size("runs")).over(record)).where("size(runs) > 0 or (start = 0 and _all = 0)")
    return some.select("file", (F.col("rec") - 1).alias("seq_idx"), "name", "length", "runs")
