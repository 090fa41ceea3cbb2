"""Registered queries of reports, converters, record files, read mapping and side blocks, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import composition, kmers, pairs, runs, segments, simulate, windows
from ..sources import formats, reports, text
from ..storage import fresh_path, stored
from .adapters import ALN_SQL, BASES, LETTERS, SEQS_SQL, aln, aln_rows, seqs
from .queries import (
    BASE_SQL,
    BLOCKS_SQL,
    CELLS_SQL,
    COMP_SQL,
    EDITS_SQL,
    KMER_SQL,
    NAMED_SQL,
    PAIRS_SQL,
    RESTORE_SQL,
    RUNS_SQL,
    SCORED_SQL,
    SEEDS_SQL,
    SEQ_CELLS_SQL,
    _as_lines,
    _carrying,
    _draw_sql,
    _edits,
    _named,
    _own_and_aligned,
    drawable_segments,
    n_runs,
)
from .registry import query

# ---- sequences with their runs


@query(f"""WITH {SEQ_CELLS_SQL}, r AS ({RUNS_SQL.format(keys='seq_idx', s='N', cells='sc')})
SELECT s.seq_idx, name, translate(core, 'ACGT-', '12347') AS codes, length(core) AS length, all_length, coalesce(r.runs, '') AS runs
FROM (SELECT seq_idx, 's' || CAST(seq_idx AS VARCHAR) AS name, replace(seq, 'N', '') AS core, length(seq) AS all_length FROM seqs) s
LEFT JOIN (SELECT seq_idx, string_agg(CAST(idx AS VARCHAR) || ':' || CAST(number AS VARCHAR), ' ' ORDER BY idx) AS runs FROM r GROUP BY seq_idx) r ON r.seq_idx = s.seq_idx""")
def fasta_coded(spark, sf_dir):
    """FASTA records as codes without N, their N runs beside them."""
    lines = _as_lines(formats.render_fasta(seqs(spark, sf_dir)).withColumn("f", F.lit("all")), "f", "seq_idx")
    found = formats.coded_records(formats.parse_fasta(lines), ("file", "seq_idx"))
    return found.select(F.expr("cast(substr(name, 2) as bigint)").alias("seq_idx"), "name", "codes", "length", "all_length", _runs_text())


def _runs_text():
    return F.array_join(F.transform("n_runs", lambda r: F.concat_ws(":", r["idx"].cast("string"), r["number"].cast("string"))), " ").alias("runs")


@query(f"""WITH {NAMED_SQL}, cl AS (SELECT aln_id, row_idx, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos, unnest(string_split(seq, '')) AS base FROM aln), r AS ({RUNS_SQL.format(keys='aln_id, row_idx', s='N', cells='cl')})
SELECT CAST(n.aln_id AS VARCHAR) AS file, n.row_idx AS read_idx, replace(seq, 'N', '') AS seq, coalesce(r.runs, '') AS runs FROM nm n
LEFT JOIN (SELECT aln_id, row_idx, string_agg(CAST(idx AS VARCHAR) || ':' || CAST(number AS VARCHAR), ' ' ORDER BY idx) AS runs FROM r GROUP BY ALL) r ON r.aln_id = n.aln_id AND r.row_idx = n.row_idx""")
def fastq_n_runs(spark, sf_dir):
    """FASTQ reads without N, their N runs beside them."""
    rows = _named(spark, sf_dir).select("aln_id", "row_idx", F.concat_ws("\n", F.concat(F.lit("@read "), F.col("row_idx")), "seq", F.lit("+"), F.repeat(F.lit("I"), F.length("seq"))).alias("text"))
    reads = formats.parse_fastq(_as_lines(rows, "aln_id", "row_idx"))
    return runs.with_runs(reads.withColumnsRenamed({"seq": "core", "raw": "seq"}), "N", ("file", "read_idx")).select("file", "read_idx", F.col("core").alias("seq"), _runs_text())


@query(f"WITH {SEQS_SQL} SELECT 's' || CAST(seq_idx AS VARCHAR) AS name, upper(seq) AS seq FROM seqs")
def fasta_files(spark, sf_dir):
    """Sequences written as wrapped FASTA files and read again from them."""
    path = fresh_path(spark, "fasta")
    text.write_text(formats.render_fasta(seqs(spark, sf_dir), width=70), path, ["seq_idx"])
    return formats.parse_fasta(text.read_lines(spark, path), upper=True).select("name", "seq")


# ---- restoration by name, aligned FASTA


_RESTORED_SQL = f"""{RESTORE_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY aln_id, row_idx, idx, base = '-' ORDER BY pos) AS nth FROM (SELECT *, CAST(sum(CAST(base <> '-' AS INT)) OVER (PARTITION BY aln_id, row_idx ORDER BY pos) AS BIGINT) AS idx FROM ac)),
parts AS (SELECT p.aln_id, p.row_idx, pos * 2 + 1 AS k, CASE WHEN base = '-' AND nth <= coalesce(used, 0) THEN 'N' ELSE base END AS s FROM placed p LEFT JOIN needs n ON n.aln_id = p.aln_id AND n.row_idx = p.row_idx AND n.idx = p.idx
  UNION ALL SELECT a.aln_id, a.row_idx, w.c * 2, repeat('N', CAST(coalesce(excess, 0) AS INT)) || repeat('-', CAST(w - coalesce(excess, 0) AS INT)) FROM al a JOIN widths w ON w.aln_id = a.aln_id LEFT JOIN needs n ON n.aln_id = a.aln_id AND n.row_idx = a.row_idx AND n.c = w.c AND excess > 0 WHERE a.seq <> ''),
rs AS (SELECT aln_id, row_idx, string_agg(s, '' ORDER BY k) AS seq FROM parts GROUP BY aln_id, row_idx)"""


@query(f"WITH {_RESTORED_SQL} SELECT aln_id, row_idx, 'r' || CAST(row_idx AS VARCHAR) AS name, seq FROM rs")
def n_restore_named(spark, sf_dir):
    """Restoration from run records read from text, found by name and checked."""
    rows = _own_and_aligned(spark, sf_dir).withColumn("name", F.concat(F.lit("r"), F.col("row_idx").cast("string")))
    records = runs.with_runs(rows.select("aln_id", "row_idx", "name", "seq"), "N", name="runs").select(F.struct("aln_id", "row_idx").alias("seq_idx"), "name", "seq", "runs")
    lines = formats.render_run_records(records).select("seq_idx.*", "text")
    parsed = formats.parse_listed_runs(_as_lines(lines, "aln_id", "row_idx")).withColumn("aln_id", F.col("file").cast("long"))
    return runs.restore_named(rows.where("aligned <> ''").select("aln_id", "name", F.col("aligned").alias("seq")), parsed)


@query(f"WITH {_RESTORED_SQL} SELECT aln_id, row_idx, '> ' || CAST(aln_id AS VARCHAR) || '_' || CAST(row_idx AS VARCHAR) || CASE WHEN row_idx % 3 = 1 THEN '(-)' ELSE '(+)' END || chr(10) || seq AS text FROM rs")
def aligned_fasta_signs(spark, sf_dir):
    return reports.aligned_fasta(_carrying(spark, sf_dir).where("seq <> ''"), None, _named(spark, sf_dir).select("aln_id", "row_idx", "name", (F.col("row_idx") % 3 != 1).alias("plus")))


# ---- XMFA to MAF


@query(f"""WITH {SCORED_SQL},
s AS (SELECT aln_id, avg(score) AS score FROM (SELECT aln_id, row_idx, CAST(sum(cost) AS BIGINT) AS score FROM sc GROUP BY ALL) GROUP BY aln_id),
n AS (SELECT aln_id, row_idx, 'seq-' || CAST(row_idx AS VARCHAR) AS name, length(replace(seq, '-', '')) AS len, row_idx * 10 + 1 AS start, length(seq) + 100 AS total, seq FROM aln),
w AS (SELECT aln_id, max(length(name)) + 1 AS nw, length(CAST(max(total) AS VARCHAR)) AS lw FROM n GROUP BY aln_id),
l AS (SELECT n.aln_id, row_idx, 's ' || rpad(name, CAST(nw AS INT), ' ') || lpad(CAST(start AS VARCHAR), CAST(greatest(lw, length(CAST(start AS VARCHAR))) AS INT), ' ') || ' ' || lpad(CAST(len AS VARCHAR), CAST(lw AS INT), ' ') || ' ' || CASE WHEN row_idx % 2 = 0 THEN '+' ELSE '-' END || ' ' || lpad(CAST(total AS VARCHAR), 9, ' ') || ' ' || seq AS line FROM n JOIN w ON w.aln_id = n.aln_id)
SELECT CAST(l.aln_id AS VARCHAR) AS file, 0 AS block_id, 'a score=' || format('{{:.6g}}', any_value(score)) || chr(10) || string_agg(line, chr(10) ORDER BY row_idx) || chr(10) AS text FROM l JOIN s ON s.aln_id = l.aln_id GROUP BY l.aln_id
UNION ALL SELECT DISTINCT CAST(aln_id AS VARCHAR), -1, '##maf version=1 scoring=lastz.v1.04.00' FROM aln""")
def xmfa_to_maf(spark, sf_dir):
    """One XMFA file an alignment, with the head that names its sequences, as MAF."""
    line = lambda block, at, text: F.struct(F.lit(block).cast("long").alias("block"), at.cast("long").alias("at"), text.alias("line"))

    def head(seq, i):
        texts = (F.concat(F.lit("#SequenceIndex "), (i + 1).cast("string")), F.lit("#SequenceFile x.fa"), F.concat(F.lit("#SequenceHeader >seq "), i.cast("string")), F.concat(F.lit("#SequenceLength "), (F.length(seq) + 100).cast("string"), F.lit("bp")))
        return F.array(*(line(-1, i * 4 + k, text) for k, text in enumerate(texts)))

    def body(seq, i):
        start = i * 10 + 1
        bounds = F.concat(F.lit(">"), (i + 1).cast("string"), F.lit(":"), start.cast("string"), F.lit("-"), (start + F.length(S.strip_gaps(seq)) - 1).cast("string"), F.lit(" "), F.when(i % 2 == 0, "+").otherwise("-"), F.lit(" c1"))
        return F.array(line(0, i * 4, bounds), line(0, i * 4 + 1, seq))

    every = F.concat(F.flatten(F.transform("seqs", head)), F.flatten(F.transform("seqs", body)), F.array(line(1, F.lit(0), F.lit("="))))
    return reports.xmfa_to_maf(aln_rows(spark, sf_dir).select(F.col("aln_id").cast("string").alias("file"), F.explode(every).alias("l")).select("file", "l.*"))


# ---- side blocks


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pairs of the centre and the reverse complement of each row, cut to one length; N runs in coordinates without N)."""
    rows = aln(spark, sf_dir).where("row_idx < 4").withColumn("seq", S.strip_gaps(F.col("seq"))).withColumn("core", S.strip_n(F.col("seq")))
    rows = stored(rows.where("seq <> ''"), "sides")
    centre = rows.where("row_idx = 0").select("aln_id", F.col("core").alias("ca"))
    both = rows.where("row_idx > 0").join(centre, "aln_id").withColumn("n", F.least(F.length("core"), F.length("ca")) - 3).where("n > 3")
    a = F.expr("substr(ca, 3, n)")
    b = S.reverse_complement(F.expr("substr(core, 2, n)"))
    pairs_ = both.select("aln_id", "row_idx", a.alias("a"), b.alias("b"), F.lit(2).cast("long").alias("a_start"), (F.col("n") + 2).cast("long").alias("a_end"), F.lit(1).cast("long").alias("b_start"), (F.col("n") + 1).cast("long").alias("b_end"))
    return pairs_, runs.symbol_runs(rows, "N")


SIDES_SQL = f"""{ALN_SQL},
sd AS (SELECT aln_id, row_idx, replace(seq, '-', '') AS seq, replace(replace(seq, '-', ''), 'N', '') AS core FROM aln WHERE row_idx < 4 AND replace(seq, '-', '') <> ''),
dc AS (SELECT aln_id, row_idx, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos, unnest(string_split(seq, '')) AS base FROM sd),
nr AS ({RUNS_SQL.format(keys='aln_id, row_idx', s='N', cells='dc')}),
pr AS (SELECT b.aln_id, b.row_idx, least(length(b.core), length(a.core)) - 3 AS n, a.core AS ca, b.core AS cb FROM sd b JOIN sd a ON a.aln_id = b.aln_id AND a.row_idx = 0 WHERE b.row_idx > 0 AND least(length(b.core), length(a.core)) - 3 > 3),
sides AS (SELECT aln_id, row_idx, n, 0 AS side, substr(ca, 3, CAST(n AS INT)) AS seq FROM pr UNION ALL SELECT aln_id, row_idx, n, 1, translate(reverse(substr(cb, 2, CAST(n AS INT))), 'ACGT', 'TGCA') FROM pr),
ins AS (SELECT p.aln_id, p.row_idx, 0 AS side, r.idx - 2 AS c, r.number FROM pr p JOIN nr r ON r.aln_id = p.aln_id AND r.row_idx = 0 AND r.idx > 2 AND r.idx < n + 2
  UNION ALL SELECT p.aln_id, p.row_idx, 1, n + 1 - r.idx, r.number FROM pr p JOIN nr r ON r.aln_id = p.aln_id AND r.row_idx = p.row_idx AND r.idx > 1 AND r.idx < n + 1),
wd AS (SELECT aln_id, row_idx, c, max(number) AS w FROM ins GROUP BY ALL),
parts AS (SELECT aln_id, row_idx, side, pos * 2 + 1 AS k, base AS s FROM (SELECT aln_id, row_idx, side, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos, unnest(string_split(seq, '')) AS base FROM sides)
  UNION ALL SELECT wd.aln_id, wd.row_idx, x.side, wd.c * 2, repeat('N', CAST(coalesce(i.number, 0) AS INT)) || repeat('-', CAST(w - coalesce(i.number, 0) AS INT)) FROM wd, (SELECT unnest([0, 1]) AS side) x LEFT JOIN ins i ON i.aln_id = wd.aln_id AND i.row_idx = wd.row_idx AND i.c = wd.c AND i.side = x.side),
full_ AS (SELECT aln_id, row_idx, side, string_agg(s, '' ORDER BY k) AS seq FROM parts GROUP BY ALL),
pc AS MATERIALIZED (SELECT a.aln_id, a.row_idx, generate_subscripts(string_split(a.seq, ''), 1) - 1 AS pos, unnest(string_split(a.seq, '')) AS x, unnest(string_split(b.seq, '')) AS y FROM full_ a JOIN full_ b ON b.aln_id = a.aln_id AND b.row_idx = a.row_idx AND a.side = 0 AND b.side = 1),
co AS (SELECT *, CASE WHEN x = '-' OR y = '-' THEN -2 WHEN x = 'N' OR y = 'N' THEN 0 WHEN x = y THEN 1 ELSE -2 END AS cost FROM pc),
ps AS (SELECT *, sum(cost) OVER (PARTITION BY aln_id, row_idx ORDER BY pos) AS s FROM co),
lo AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY aln_id, row_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM ps),
be AS MATERIALIZED (SELECT aln_id, row_idx, pos AS stop, low FROM lo WHERE s - low > 0 QUALIFY row_number() OVER (PARTITION BY aln_id, row_idx ORDER BY s - low DESC, pos) = 1),
re AS (SELECT be.aln_id, be.row_idx, min(ps.pos) AS reset FROM be JOIN ps ON ps.aln_id = be.aln_id AND ps.row_idx = be.row_idx AND ps.pos < be.stop AND ps.s = be.low AND be.low < 0 GROUP BY ALL),
sp AS (SELECT be.aln_id, be.row_idx, stop, coalesce(reset + 1, 0) AS start FROM be LEFT JOIN re ON re.aln_id = be.aln_id AND re.row_idx = be.row_idx),
fm AS (SELECT sp.aln_id, sp.row_idx, 2 + count(*) FILTER (x <> '-' AND pos < start) AS a_at, count(*) FILTER (x <> '-' AND pos BETWEEN start AND stop) AS a_len, string_agg(x, '' ORDER BY pos) FILTER (pos BETWEEN start AND stop) AS a,
  1 + count(*) FILTER (y <> '-' AND pos > stop) AS b_at, count(*) FILTER (y <> '-' AND pos BETWEEN start AND stop) AS b_len, string_agg(y, '' ORDER BY pos) FILTER (pos BETWEEN start AND stop) AS b
  FROM sp JOIN pc ON pc.aln_id = sp.aln_id AND pc.row_idx = sp.row_idx WHERE stop - start >= 2 GROUP BY sp.aln_id, sp.row_idx),
fd AS (SELECT *, a_at + coalesce((SELECT sum(number) FROM nr r WHERE r.aln_id = fm.aln_id AND r.row_idx = 0 AND r.idx <= 2), 0) AS a_start, b_at + coalesce((SELECT sum(number) FROM nr r WHERE r.aln_id = fm.aln_id AND r.row_idx = fm.row_idx AND r.idx <= 1), 0) AS b_start FROM fm)"""


@query(f"WITH {SIDES_SQL} SELECT aln_id, row_idx, CAST(a_start AS BIGINT) AS a_start, a_len, a, CAST(b_start AS BIGINT) AS b_start, b_len, b FROM fd")
def side_blocks(spark, sf_dir):
    """Reverse-complement blocks with their unknown bases, trimmed to the maximum-scoring segment."""
    return segments.side_blocks(*_sides(spark, sf_dir), least=2)


@query(f"""WITH {SIDES_SQL}, nm AS (SELECT aln_id, row_idx, CAST(aln_id AS VARCHAR) || '_' || CAST(row_idx AS VARCHAR) AS name, length(seq) AS total FROM sd),
v AS (SELECT fd.*, a.name AS an, a.total AS ta, b.name AS bn, b.total AS tb, greatest(length(a.name), length(b.name)) + 1 AS w FROM fd JOIN nm a ON a.aln_id = fd.aln_id AND a.row_idx = 0 JOIN nm b ON b.aln_id = fd.aln_id AND b.row_idx = fd.row_idx)
SELECT aln_id, row_idx, 'a score= 0 ' || chr(10) || 's ' || rpad(an, CAST(w AS INT), ' ') || printf('%9d %9d + %9d ', CAST(a_start AS BIGINT), a_len, ta) || a || chr(10) || 's ' || rpad(bn, CAST(w AS INT), ' ') || printf('%9d %9d %s %9d ', CAST(b_start AS BIGINT), b_len, CASE WHEN row_idx % 2 = 0 THEN '-' ELSE '+' END, tb) || b || chr(10) AS text FROM v""")
def side_block_maf(spark, sf_dir):
    names = _named(spark, sf_dir).select("aln_id", "row_idx", "name", F.length(S.strip_gaps(F.col("seq"))).alias("total"), (F.col("row_idx") % 2 == 0).alias("plus"))
    return reports.side_block_maf(side_blocks(spark, sf_dir), names)


# ---- runs and blocks


@query(f"""WITH {CELLS_SQL}, col AS (SELECT aln_id, pos, min(base) = max(base) AND min(base) <> '-' AS same FROM cells GROUP BY ALL),
isl AS (SELECT *, sum(CAST(NOT same AS INT)) OVER (PARTITION BY aln_id ORDER BY pos) AS island FROM col),
bl AS (SELECT aln_id, min(pos) AS start, count(*) AS length FROM isl WHERE same GROUP BY aln_id, island HAVING count(*) >= 2),
st AS (SELECT aln_id, row_idx, pos, CAST(sum(CAST(base <> '-' AS INT)) OVER (PARTITION BY aln_id, row_idx ORDER BY pos) AS BIGINT) - 1 AS row_start FROM cells)
SELECT bl.aln_id, bl.start, bl.length, st.row_idx, st.row_start FROM bl JOIN st ON st.aln_id = bl.aln_id AND st.pos = bl.start""")
def exact_match_rows(spark, sf_dir):
    return segments.exact_match_rows(aln(spark, sf_dir), 2)


@query(f"""WITH {CELLS_SQL}, r AS ({RUNS_SQL.format(keys='aln_id, row_idx', s='N', cells='cells')}),
b AS (SELECT aln_id, row_idx, unnest(range(0, length(replace(seq, 'N', '')), 50)) AS start FROM aln)
SELECT b.aln_id, b.row_idx, b.start, CAST(coalesce(sum(number), 0) AS BIGINT) AS before FROM b LEFT JOIN r ON r.aln_id = b.aln_id AND r.row_idx = b.row_idx AND r.idx <= b.start GROUP BY b.aln_id, b.row_idx, b.start""")
def block_n_offsets(spark, sf_dir):
    """N before the start of each stretch of 50 bases."""
    starts = aln(spark, sf_dir).select("aln_id", "row_idx", F.length(S.strip_n(F.col("seq"))).alias("n")).where("n > 0").select("aln_id", "row_idx", F.explode(F.expr("sequence(0L, cast(n as bigint) - 1, 50L)")).alias("start"))
    return runs.offsets_at(starts, n_runs(spark, sf_dir))


@query(f"""WITH {SEQ_CELLS_SQL} SELECT seq_idx, pos, base, {', '.join(f"CAST(sum(CAST(base = '{s}' AS INT)) OVER (PARTITION BY seq_idx ORDER BY pos) AS BIGINT) AS n_{k}" for k, s in composition.SYMBOLS.items())} FROM sc""")
def occurrence_table(spark, sf_dir):
    return composition.occurrence_table(seqs(spark, sf_dir), "seq_idx")


# ---- reports


@query(f"""WITH {SEQS_SQL}, s AS (SELECT count(*) AS n, min(length(seq)) AS lo, max(length(seq)) AS hi, CAST(sum(length(seq)) AS BIGINT) AS total, avg(length(seq)) AS mean FROM seqs)
SELECT CAST(i AS INT) AS line_no, CASE i WHEN 0 THEN 'Dataset size: ' || n WHEN 1 THEN 'Min length: ' || lo WHEN 2 THEN 'Max length: ' || hi WHEN 3 THEN 'Sum length: ' || total ELSE 'Avg length: ' || format('{{:.6g}}', mean) END AS text FROM s, (SELECT unnest(range(5)) AS i)""")
def length_report_whole(spark, sf_dir):
    """All lines of the length report, the average with six digits."""
    return reports.render_stats(pairs.length_stats(seqs(spark, sf_dir)))


@query(f"""WITH {COMP_SQL}, t AS (SELECT aln_id, sp, CAST(sp AS DOUBLE) / np AS mean, CAST(sp AS DOUBLE) / np / n AS scaled FROM (SELECT aln_id, CAST(sum(n_match - n_mismatch - 2 * n_gap1) AS BIGINT) AS sp, max(n_match + n_mismatch + n_gap1 + n_gap2) AS np, count(*) AS n FROM cls GROUP BY aln_id))
SELECT aln_id, CAST(i AS INT) AS line_no, CASE i WHEN 0 THEN 'SP score: ' || sp WHEN 1 THEN 'Avg SP score: ' || format('{{:.6g}}', mean) ELSE 'Scaled SP score: ' || format('{{:.6g}}', scaled) END AS text FROM t, (SELECT unnest(range(3)) AS i)""")
def sp_report_whole(spark, sf_dir):
    """All lines of the sum-of-pairs report, averages with six digits."""
    return reports.render_sp(composition.sp_scores(composition.column_counts(aln(spark, sf_dir))))

@query(f"""WITH {SEQS_SQL}, s AS (SELECT count(*) AS n, min(length(seq)) AS lo, max(length(seq)) AS hi, CAST(sum(length(seq)) AS BIGINT) AS total FROM seqs)
SELECT CAST(i AS INT) AS line_no, CASE i WHEN 0 THEN 'Dataset size: ' || n WHEN 1 THEN 'Min length: ' || lo WHEN 2 THEN 'Max length: ' || hi ELSE 'Sum length: ' || total END AS text FROM s, (SELECT unnest(range(4)) AS i)""")
def length_report(spark, sf_dir):
    """The whole-number lines of the length report."""
    return reports.render_stats(pairs.length_stats(seqs(spark, sf_dir))).where("line_no < 4")


@query(f"""WITH {PAIRS_SQL}, m AS (SELECT aln_id, row_idx AS i, count(*) FILTER (x = y AND x NOT IN ('N', '-')) AS k, count(*) FILTER (y <> '-') AS n FROM pc GROUP BY ALL)
SELECT aln_id, i + 1 AS line_no, i || chr(9) || CASE WHEN i = 0 THEN '--' ELSE CAST(k AS VARCHAR) END || chr(9) || n || chr(9) || CASE WHEN i = 0 THEN '---' WHEN n = 0 THEN 'nan' ELSE format('{{:.6g}}', CAST(k AS DOUBLE) / n) END || chr(9) || aln_id || '_' || i AS text FROM m
UNION ALL SELECT DISTINCT aln_id, 0, 'I' || chr(9) || 'Match_num' || chr(9) || 'Len_sequence' || chr(9) || 'M/L' || chr(9) || 'Name' FROM m""")
def match_report(spark, sf_dir):
    return reports.render_matches(pairs.match_table(aln(spark, sf_dir)).withColumn("name", F.concat_ws("_", "aln_id", "i")))


@query(f"""WITH {COMP_SQL} SELECT aln_id, 0 AS line_no, 'SP score: ' || CAST(sum(n_match - n_mismatch - 2 * n_gap1) AS BIGINT) AS text FROM cls GROUP BY aln_id""")
def sp_report(spark, sf_dir):
    """The whole-number line of the sum-of-pairs report."""
    return reports.render_sp(composition.sp_scores(composition.column_counts(aln(spark, sf_dir)))).where("line_no = 0")


@query(f"""WITH {BLOCKS_SQL}, m AS (SELECT *, count(*) FILTER (a_fwd = b_fwd) OVER (PARTITION BY other) * 2 > count(*) OVER (PARTITION BY other) AS maj FROM pb),
d AS (SELECT other, ord, a_start AS x1, CASE WHEN a_fwd = b_fwd THEN b_start WHEN maj THEN b_total - b_start ELSE b_start + b_len END AS y1, a_start + a_len AS x2, CASE WHEN a_fwd = b_fwd THEN b_start + b_len WHEN maj THEN b_total - b_start - b_len ELSE b_start END AS y2 FROM m),
t AS (SELECT CAST(a.aln_id AS VARCHAR) || '_' || CAST(a.row_idx AS VARCHAR) AS other, length(replace(c.seq, '-', '')) AS ta, length(replace(a.seq, '-', '')) AS tb FROM aln a JOIN aln c ON c.aln_id = a.aln_id AND c.row_idx = 0)
SELECT other, row_number() OVER (PARTITION BY other ORDER BY ord, x1, y1, x2, y2) AS line_no, '<line x1="' || x1 || '" y1="' || y1 || '" x2="' || x2 || '" y2="' || y2 || '" stroke="' || CASE WHEN y2 >= y1 THEN 'red' ELSE 'dodgerblue' END || '"/>' AS text FROM d
UNION ALL SELECT other, 0, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || ta || ' ' || tb || '">' FROM t UNION ALL SELECT other, 4611686018427387904, '</svg>' FROM t""")
def dotplot_svg(spark, sf_dir):
    rows = aln(spark, sf_dir).select("aln_id", F.concat_ws("_", "aln_id", "row_idx").alias("other"), "row_idx", F.length(S.strip_gaps(F.col("seq"))).alias("b_total"))
    centre = rows.where("row_idx = 0").select("aln_id", F.col("b_total").alias("a_total"))
    return reports.render_dotplot(drawable_segments(spark, sf_dir), rows.join(centre, "aln_id").select("other", "a_total", "b_total"))


@query(f"""WITH {SEQ_CELLS_SQL}, {EDITS_SQL}, f AS (SELECT seq_idx, pos FROM sc WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.seq_idx = sc.seq_idx AND pos >= start AND pos < start + len)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_idx ORDER BY pos) AS island FROM f) SELECT seq_idx, min(pos) AS start, count(*) AS len FROM i GROUP BY seq_idx, island HAVING count(*) >= 20""")
def free_places(spark, sf_dir):
    """Stretches of 20 or more positions that no edit touches."""
    totals = seqs(spark, sf_dir).where("seq <> ''").select("seq_idx", F.length("seq").alias("total"))
    return segments.free_intervals(totals, _edits(spark, sf_dir), ["seq_idx"], 20)


def _block_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each alignment as one block: (names, blocks, rows)."""
    rows = _named(spark, sf_dir)
    names = rows.select("aln_id", "row_idx", "name", (F.length("seq") + 100).alias("length"), (F.col("row_idx") % 2 == 0).alias("plus"))
    blocks = windows.gap_columns(composition.column_counts(rows)).select("aln_id", F.lit(0).cast("long").alias("block_id"), (F.col("columns") * 1.5).alias("score"), "columns", "gap_columns")
    return names, blocks, rows.select("aln_id", F.lit(0).cast("long").alias("block_id"), "row_idx", (F.col("row_idx") * 7).alias("start"), F.length(S.strip_gaps(F.col("seq"))).alias("len"), "seq")


def _parsed_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return reports.parse_blocks(_as_lines(reports.render_blocks(*_block_tables(spark, sf_dir)), "aln_id", "block_id"))


@query(f"""WITH {NAMED_SQL}, g AS (SELECT aln_id, count(*) AS columns, count(*) FILTER (gap) AS gap_columns FROM (SELECT aln_id, pos, bool_or(base = '-') AS gap FROM (SELECT aln_id, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos, unnest(string_split(seq, '')) AS base FROM aln) GROUP BY ALL) GROUP BY aln_id)
SELECT CAST(n.aln_id AS VARCHAR) AS file, 0 AS block_id, CAST(format('{{:.6g}}', columns * 1.5::DOUBLE) AS DOUBLE) AS score, columns, gap_columns, row_idx, row_idx * 7 AS start, length(replace(seq, '-', '')) AS len, seq FROM nm n JOIN g ON g.aln_id = n.aln_id""")
def block_table_rows(spark, sf_dir):
    """A block table written as text and read again: blocks and their rows."""
    _, blocks, rows = _parsed_blocks(spark, sf_dir)
    return rows.join(blocks, ["file", "block_id"])


@query(f"WITH {NAMED_SQL} SELECT CAST(aln_id AS VARCHAR) AS file, row_idx, name, length(seq) + 100 AS length, row_idx % 2 = 0 AS plus FROM nm")
def block_table_names(spark, sf_dir):
    return _parsed_blocks(spark, sf_dir)[0]


# ---- read mapping and generators


@query(f"""WITH RECURSIVE {SEQS_SQL}, refs AS (SELECT item_id AS ref_idx, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM benchmark),
reads AS (SELECT seq_idx AS read_idx, '+' AS strand, seq FROM seqs UNION ALL SELECT seq_idx, '-', translate(reverse(seq), 'ACGT', 'TGCA') FROM seqs),
rk AS ({KMER_SQL.format(keys='ref_idx', k=15, t='refs')}), qk AS (SELECT {{'r': read_idx, 's': strand}} AS query_idx, pos, kmer FROM ({KMER_SQL.format(keys='read_idx, strand', k=15, t='reads')})),
{SEEDS_SQL.format(on='q.kmer = r.kmer').replace('SELECT q.ref_idx, query_idx', 'SELECT r.ref_idx, query_idx')} SELECT query_idx.r AS read_idx, query_idx.s AS strand, ref_idx, ref_pos, query_pos, length FROM seeds""")
def read_mapping(spark, sf_dir):
    """Both strands of all sequences against the benchmark's as references."""
    letters = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    references = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("ref_idx"), F.translate(letters, LETTERS, BASES).alias("seq"))
    return kmers.map_reads(seqs(spark, sf_dir).select(F.col("seq_idx").alias("read_idx"), "seq"), references, 15)


@query(f"WITH {SEQS_SQL} SELECT seq_idx, array_to_string(list_transform(range(100), lambda p: {BASE_SQL.format(n='(' + _draw_sql('seq_idx + 1', 'p', 1) + ' >> 8)')}), '') AS seq FROM seqs")
def random_bases(spark, sf_dir):
    return simulate.random_sequences(seqs(spark, sf_dir).select("seq_idx"), 100)


@query(f"""WITH {SEQS_SQL}, p AS (SELECT seq_idx, unnest(range(60)) AS pos FROM seqs), r AS (SELECT *, row_number() OVER (PARTITION BY seq_idx ORDER BY {_draw_sql('seq_idx + 1', 'pos', 2)}, pos) AS k FROM p)
SELECT seq_idx, string_agg(CASE WHEN k <= 15 THEN 'A' WHEN k <= 30 THEN 'C' WHEN k <= 45 THEN 'T' ELSE 'G' END, '' ORDER BY pos) AS seq FROM r GROUP BY seq_idx""")
def balanced_bases(spark, sf_dir):
    return simulate.balanced_sequences(seqs(spark, sf_dir).select("seq_idx"), 60)
