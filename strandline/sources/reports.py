"""Reports and block tables as text, and a converter of XMFA to MAF.

All return rows of text with the columns that order them; nothing is gathered to write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.runs import restore_unknown
from ..operators.summaries import mean_scores
from ..session import ship
from .formats import parse_xmfa_blocks, parse_xmfa_head, render_fasta
from .text import number, six_digits


def _left(value: Column, width: Column | int) -> Column:
    """``value`` padded on its right to ``width``, never cut."""
    return F.concat(value, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(value)).cast("int")))


def _right(value: Column, width: Column | int) -> Column:
    text = value.cast("string")
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text)).cast("int")), text)


def _in_order(order: str, value: str, mark: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), mark)


# ---- MAF


def _widths(name: str, number: str) -> list[Column]:
    return [(F.max(F.length(name)) + 1).alias("name_width"), F.length(F.max(number).cast("string")).alias("number_width")]


def widths(rows: DataFrame, *keys: str, name: str = "name", number: str = "length") -> DataFrame:
    """keys, name_width (the longest name and one), number_width (digits of the largest number)."""
    return rows.groupBy(*keys).agg(*_widths(name, number))


def maf_line(name: Column, name_width: Column | int, start: Column, length: Column, number_width: Column | int, strand: Column, total: Column, seq: Column, total_width: int = 9) -> Column:
    return F.concat(F.lit("s "), _left(name, name_width), _right(start, number_width), F.lit(" "), _right(length, number_width), F.lit(" "), strand, F.lit(" "), _right(total, total_width), F.lit(" "), seq)


#: Fixed value: the first line of a MAF file.
MAF_HEAD = "##maf version=1 scoring=lastz.v1.04.00"


def xmfa_to_maf(lines: DataFrame) -> DataFrame:
    """file, block_id, text: the blocks of XMFA files as scored MAF; block -1 is the head line.

    Ids become the names and lengths that the file's head gives them (an id that it does
    not list is an error), columns are as wide as the file's longest name and largest
    length, and a block's score is the mean of its rows' scores against its first row.

    A block is one row of text in the end, so its rows meet once and are scored and written
    there; no chunk of them is joined.
    """
    head, blocks = parse_xmfa_head(lines), parse_xmfa_blocks(lines)
    ship(lines.sparkSession)
    parts = ("row_ord", "id", "start", "len", "strand", "seq")
    whole = blocks.groupBy("file", "block_id").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("rows"))
    known = F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("int"), F.struct("name", F.col("length").alias("total")))))
    files = head.groupBy("file").agg(known.alias("known"), *_widths("name", "length"))
    named = whole.withColumn("score", mean_scores(F.transform("rows", lambda r: F.upper(r["seq"])))).where("score is not null").join(files, "file", "left")

    def line(r: Column) -> Column:
        own = F.try_element_at("known", r["id"])
        name = F.when(own["name"].isNull(), F.raise_error(F.concat(F.lit("no sequence has the index "), F.coalesce(r["id"].cast("string"), F.lit(""))))).otherwise(own["name"])
        return maf_line(name, F.col("name_width"), r["start"], r["len"], F.col("number_width"), r["strand"], own["total"], r["seq"])

    text = F.concat(F.lit("a score="), six_digits(F.col("score")), F.lit("\n"), F.array_join(F.transform("rows", line), "\n"), F.lit("\n"))
    return named.select("file", "block_id", text.alias("text")).unionByName(head.select("file").distinct().select("file", F.lit(-1).cast("long").alias("block_id"), F.lit(MAF_HEAD).alias("text")))


def side_block_maf(found: DataFrame, names: DataFrame) -> DataFrame:
    """aln_id, row_idx, text: two-row MAF blocks of side blocks.

    ``names`` has aln_id, row_idx, name, total (bases with N) and plus, whether the row was
    aligned on its own strand: the side block then lies on the other one.
    """
    a = names.where("row_idx = 0").select("aln_id", F.col("name").alias("a_name"), F.col("total").alias("a_total"))
    both = found.join(a, "aln_id").join(names, ["aln_id", "row_idx"])
    wide = F.greatest(F.length("a_name"), F.length("name")) + 1
    first = maf_line(F.col("a_name"), wide, F.col("a_start"), F.col("a_len"), 9, F.lit("+"), F.col("a_total"), F.col("a"))
    second = maf_line(F.col("name"), wide, F.col("b_start"), F.col("b_len"), 9, F.when(F.col("plus"), "-").otherwise("+"), F.col("total"), F.col("b"))
    return both.select("aln_id", "row_idx", F.concat_ws("\n", F.lit("a score= 0 "), first, second, F.lit("")).alias("text"))


# ---- aligned FASTA


def aligned_fasta(aligned: DataFrame, n_runs: DataFrame | None, names: DataFrame) -> DataFrame:
    """aln_id, row_idx, text: rows with their unknown bases back, named with their strand in brackets; ``names`` has name and plus.  Rows may carry their runs, as in :func:`restore_unknown`."""
    rows = restore_unknown(aligned, n_runs).join(names, ["aln_id", "row_idx"])
    text = render_fasta(rows.select(F.struct("aln_id", "row_idx").alias("seq_idx"), "name", "seq", F.when(F.col("plus"), "+").otherwise("-").alias("sign")), "> ", sign="sign")
    return text.select("seq_idx.*", "text")


# ---- reports


def render_stats(stats: DataFrame) -> DataFrame:
    """line_no, text: the lines of a length report; the average has six significant digits."""
    shown = F.array(*(F.concat(F.lit(f"{title}: "), six_digits(F.col(c)) if c == "avg_len" else F.col(c).cast("string")) for title, c in (("Dataset size", "size"), ("Min length", "min_len"), ("Max length", "max_len"), ("Sum length", "sum_len"), ("Avg length", "avg_len"))))
    return stats.select(F.posexplode(shown).alias("line_no", "text"))


def render_sp(scores: DataFrame) -> DataFrame:
    """aln_id, line_no, text: the report of sum-of-pairs scores of each alignment; averages have six significant digits."""
    shown = F.array(*(F.concat(F.lit(f"{title}: "), F.col(c).cast("string") if c == "sp" else six_digits(F.col(c))) for title, c in (("SP score", "sp"), ("Avg SP score", "avg_sp"), ("Scaled SP score", "scaled_sp"))))
    return scores.select("aln_id", F.posexplode(shown).alias("line_no", "text"))


def render_dotplot(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """other, line_no, text: an SVG drawing of each pair, the origin at the upper left.

    ``segments``: other, ord, x1, y1, x2, y2, as :func:`drawable_segments` gives them;
    ``totals``: other, a_total, b_total.  Segments that rise are red, the others blue.
    """
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    number = F.row_number().over(Window.partitionBy("other").orderBy("ord", "x1", "y1", "x2", "y2")).cast("long")
    colour = F.when(F.col("y2") >= F.col("y1"), "red").otherwise("dodgerblue")
    drawn = segments.select("other", number.alias("line_no"), line('<line x1="', F.col("x1"), '" y1="', F.col("y1"), '" x2="', F.col("x2"), '" y2="', F.col("y2"), '" stroke="', colour, '"/>').alias("text"))
    head = line('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ', F.col("a_total"), " ", F.col("b_total"), '">')
    first = totals.select("other", F.lit(0).cast("long").alias("line_no"), head.alias("text"))
    last = totals.select("other", F.lit(2**62).cast("long").alias("line_no"), F.lit("</svg>").alias("text"))
    return drawn.unionByName(first).unionByName(last)


def render_matches(table: DataFrame) -> DataFrame:
    """aln_id, line_no, text: the tab-separated match report of each alignment; ``table`` has a name for each row, row 0 is the centre."""
    centre = F.col("i") == 0
    line = F.concat_ws("\t", F.col("i").cast("string"), F.when(centre, "--").otherwise(F.col("match_num").cast("string")), F.col("len_sequence").cast("string"), F.when(centre, "---").otherwise(F.when(F.col("ratio").isNull(), "nan").otherwise(six_digits(F.col("ratio")))), "name")
    head = table.select("aln_id").distinct().select("aln_id", F.lit(0).cast("long").alias("line_no"), F.lit("I\tMatch_num\tLen_sequence\tM/L\tName").alias("text"))
    return table.select("aln_id", (F.col("i") + 1).cast("long").alias("line_no"), line.alias("text")).unionByName(head)


# ---- block tables


def render_blocks(names: DataFrame, blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """aln_id, block_id, text: a block table; block -1 is the head.

    ``names``: aln_id, row_idx, name, length, plus.  ``blocks``: aln_id, block_id, score,
    columns, gap_columns.  ``rows``: aln_id, block_id, row_idx, start, len, seq.
    """
    listed = lambda c, mark: _in_order("row_idx", c, mark)
    signs = names.withColumn("sign", F.col("plus").cast("int").cast("string")).withColumn("length", F.col("length").cast("string"))
    head = signs.groupBy("aln_id").agg(F.concat(F.count("*").cast("string"), F.lit("\n"), listed("name", "\n"), F.lit("\n"), listed("length", " "), F.lit(" \n"), listed("sign", " "), F.lit(" \n")).alias("text"))
    line = F.concat_ws(" ", F.col("row_idx").cast("string"), F.col("start").cast("string"), F.col("len").cast("string"), "seq")
    bodies = rows.withColumn("line", line).groupBy("aln_id", "block_id").agg(F.count("*").alias("n"), _in_order("row_idx", "line").alias("body"))
    first = F.concat_ws(" ", six_digits(F.col("score")), F.col("n").cast("string"), F.col("columns").cast("string"))
    body = bodies.join(blocks, ["aln_id", "block_id"]).select("aln_id", "block_id", F.concat_ws("\n", first, "body", F.col("gap_columns").cast("string")).alias("text"))
    return body.unionByName(head.select("aln_id", F.lit(-1).cast("long").alias("block_id"), "text"))


def parse_blocks(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, blocks, rows) of block tables, with ``file`` in the place of ``aln_id``.

    A file's first line says how many names follow; behind them come lengths and signs, and
    then blocks, each beginning with three numbers.
    """
    three = F.col("line").rlike(r"^-?[\d.]+(e[+-]?\d+)? \d+ \d+\s*$")
    numbered = number(lines, {"nth": three})
    count = numbered.where("line_no = 0").select("file", F.trim("line").try_cast("long").alias("_n"))
    placed = numbered.join(count, "file")
    head, body = placed.where("line_no between 1 and _n + 2"), placed.where("line_no > _n + 2 and trim(line) <> ''")
    values = head.groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("line_no") <= F.col("_n"), F.struct("line_no", "line")))), lambda x: x["line"]).alias("name"),
        *(F.split(F.trim(F.max(F.when(F.col("line_no") == F.col("_n") + k, F.col("line")))), r"\s+").alias(c) for k, c in ((1, "length"), (2, "sign"))),
    )
    zipped = values.select("file", F.posexplode(F.arrays_zip("name", "length", "sign")).alias("row_idx", "v"))
    names = zipped.select("file", F.col("row_idx").cast("long").alias("row_idx"), F.col("v.name").alias("name"), F.col("v.length").cast("long").alias("length"), (F.col("v.sign") == "1").alias("plus"))
    before = head.groupBy("file").agg(F.max("nth").alias("_before"))
    t = F.split(F.trim("line"), r"\s+")
    parts = body.join(before, "file").select("file", (F.col("nth") - F.col("_before") - 1).alias("block_id"), t.alias("t"), F.size(t).alias("k"))
    at = lambda i, kind: F.get("t", F.lit(i)).try_cast(kind)
    pick = lambda k, i, kind: F.max(F.when(F.col("k") == k, at(i, kind)))
    blocks = parts.groupBy("file", "block_id").agg(pick(3, 0, "double").alias("score"), pick(3, 2, "long").alias("columns"), pick(1, 0, "long").alias("gap_columns"))
    return names, blocks, parts.where("k = 4").select("file", "block_id", at(0, "long").alias("row_idx"), at(1, "long").alias("start"), at(2, "long").alias("len"), at(3, "string").alias("seq"))
