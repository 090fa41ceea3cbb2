"""Text formats from literal files, and back."""

from pyspark.sql import functions as F

from strandline.operators import runs
from strandline.sources import formats
from strandline.sources.text import read_lines, write_text

import pytest


def lines(spark, tmp_path, text, name="x.txt"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return read_lines(spark, str(path))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta(spark, tmp_path, end):
    text = "junk\n>s1 desc\nAC\n\nGU\n>s2\na:x-N".replace("\n", end)
    got = formats.parse_fasta(lines(spark, tmp_path, text)).orderBy("seq_idx").collect()
    assert [(r["seq_idx"], r["name"], r["seq"]) for r in got] == [(0, "s1 desc", "ACGU"), (1, "s2", "a:x-N")]
    both = formats.concatenated(formats.parse_fasta(lines(spark, tmp_path, text, "y"))).first()
    assert (both["name"], both["seq"]) == ("s2", "ACGUa:x-N")


def test_fasta_keeps_order_over_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        text = "".join(f">r{i}\n{'ACGT' * 5}{i}\nTT\n" for i in range(40))
        got = formats.parse_fasta(lines(spark, tmp_path, text)).orderBy("seq_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["name"], r["seq"]) for r in got] == [(f"r{i}", "ACGT" * 5 + f"{i}TT") for i in range(40)]


def test_fasta_checks(spark, tmp_path):
    rows = lines(spark, tmp_path, ">a\nAC\n>b\nACG\n>c\nTT\n").unionByName(lines(spark, tmp_path, ">a\nACGT\n>c\nTTTT\n", "y"))
    assert formats.parse_fasta_named(rows, ["a", "c"]).count() == 4  # each file has one length of its own
    with pytest.raises(Exception, match="x.txt: sequences differ in length"):
        formats.parse_fasta_named(rows, ["a", "b"]).where("file like '%x.txt'").collect()
    with pytest.raises(Exception, match="y: a named sequence is missing"):
        formats.parse_fasta_named(rows, ["a", "b"]).where("file like '%y'").collect()
    with pytest.raises(Exception, match="length"):
        formats.require_alignment(formats.parse_fasta(rows)).collect()
    assert formats.require_alignment(formats.parse_fasta(rows).where("file like '%y'")).count() == 2
    with pytest.raises(Exception, match="two sequences"):
        formats.require_alignment(formats.parse_fasta(rows).where("seq_idx = 0")).collect()
    found = {r["file"][-1]: r["problem"] for r in formats.problems(formats.parse_fasta(rows)).collect()}
    assert found == {"t": "sequences differ in length", "y": None}


def test_clustal(spark, tmp_path):
    text = "CLUSTAL W\n\na.1  ACG\nb  A-G\n   * *\na.1  TT\nb  TA\n"
    got = formats.parse_clustal(lines(spark, tmp_path, text)).orderBy("seq_idx").collect()
    assert [(r["name"], r["seq"]) for r in got] == [("a.1", "ACGTT"), ("b", "A-GTA")]
    assert [r["name"] for r in formats.parse_clustal(lines(spark, tmp_path, text, "z"), legacy=True).collect()] == ["b"]


def test_xmfa(spark, tmp_path):
    text = "#FormatVersion X\n#SequenceCount 2\n#SequenceIndex 1\n#SequenceFile a.fa\n#SequenceHeader >seq a\n#SequenceLength 10bp\n#SequenceIndex 2\n#SequenceFile b.fa\n#SequenceHeader >seq b\n#SequenceLength 9bp\n>1:1-5 + c1\nACGTA\n>2:3-6 + c1\nA-GTA\n=\n>2:1-2 - c1\nAC\n=\n"
    rows = lines(spark, tmp_path, text)
    assert [(r["id"], r["name"], r["length"]) for r in formats.parse_xmfa_head(rows).orderBy("id").collect()] == [(1, "seq-a", 10), (2, "seq-b", 9)]
    got = formats.parse_xmfa_blocks(rows).orderBy("block_id", "row_ord").collect()
    assert [(r["block_id"], r["id"], r["start"], r["len"], r["strand"], r["seq"]) for r in got] == [(0, 1, 1, 5, "+", "ACGTA"), (0, 2, 3, 4, "+", "A-GTA"), (1, 2, 1, 2, "-", "AC")]


def test_maf_both_ways(spark, tmp_path):
    text = "a score=0\ns A 0 3 + 10 ACG\ns B 2 3 - 9 ACG\n\na score=1\ns B 0 1 + 9 A\ns C 0 1 + 9 A\n"
    rows = formats.parse_maf(lines(spark, tmp_path, text))
    pair = formats.maf_pairs(rows, "A", "B").collect()
    assert [(r["a_total"], r["b_total"], r["ord"], r["a_start"], r["a_len"], r["a_fwd"], r["b_start"], r["b_len"], r["b_fwd"]) for r in pair] == [(10, 9, 0, 0, 3, True, 2, 3, False)]
    assert [r["other"] for r in formats.maf_pairs(rows, "A").collect()] == ["B"]
    scores = spark.createDataFrame([(0, 0.0), (1, 12.5)], "block_id long, score double")
    out = {r["block_id"]: r["text"] for r in formats.render_maf(rows, scores, ["block_id"], 1, 1).collect()}
    assert out[0] == "a score=0\ns A 0 3 + 10 ACG\ns B 2 3 - 9 ACG\n"
    assert out[1].startswith("a score=12.5\n")


def test_fastq(spark, tmp_path):
    got = formats.parse_fastq(lines(spark, tmp_path, "@r 1\nACNNG\n+\nIIIII\n")).first()
    assert (got["name"], got["seq"], got["seq_rc"], got["length"], got["all_length"]) == ("r-1", "ACG", "CGT", 3, 5)


def test_run_records(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "s", "NNACNGN"), (1, "t", "AC")], "seq_idx long, name string, seq string")
    found = runs.symbol_runs(seqs, "N", ("seq_idx",))
    text = formats.render_runs(seqs, found).orderBy("seq_idx")
    body = "\n".join(r["text"] for r in text.collect())
    assert body == "2         \n> s\n3 3\n0 2 \n2 1 \n3 1 \n> t\n0 2"
    got = formats.parse_runs(lines(spark, tmp_path, body)).orderBy("seq_idx", "idx").collect()
    assert [(r["name"], r["length"], r["idx"], r["number"]) for r in got] == [("s", 3, 0, 2), ("s", 3, 2, 1), ("s", 3, 3, 1), ("t", 2, None, None)]


def test_written_text_reads_back_in_order(spark, tmp_path):
    seqs = spark.createDataFrame([(i, f"n{i}", "ACGT" * 3) for i in range(20)], "seq_idx long, name string, seq string")
    write_text(formats.render_fasta(seqs, width=5), str(tmp_path / "out"), ["seq_idx"])
    got = formats.parse_fasta(read_lines(spark, str(tmp_path / "out")))
    assert {(r["name"], r["seq"]) for r in got.collect()} == {(f"n{i}", "ACGT" * 3) for i in range(20)}
    assert formats.render_fasta(seqs.withColumn("sg", F.lit("+")), sign="sg").first()["text"].startswith(">n0(+)\n")


def test_xmfa_ids_must_be_listed(spark):
    from strandline.sources import reports

    lines = ["#SequenceIndex 1", "#SequenceHeader >seq a", "#SequenceLength 10bp", ">1:1-4 + c1", "ACGT", ">2:3-6 + c1", "AC-T", "="]
    table = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(lines)], "file string, block long, at long, line string")
    with pytest.raises(Exception, match="no sequence has the index 2"):
        reports.xmfa_to_maf(table).collect()


def test_xmfa_blocks_are_scored_where_their_rows_meet(spark):
    """Several blocks and splits of a file, wrapped, long, uneven and empty rows; against scores of joined chunks. No chunk is a row."""
    import random

    from strandline.operators.columns import pair_chunks
    from strandline.operators.windows import block_scores, window_scores
    from strandline.sources import reports

    pick = random.Random(4)
    text = lambda n: "".join(pick.choices("acgtN-", k=n))
    blocks = [[text(2300), text(2300)], ["AC", "ACG", "A"], [text(1000) + "-", text(999) + "--", text(1500)], ["ACGT"], ["", "A"], ["é-A", "C-é"]]
    lines = [x for i in range(3) for x in (f"#SequenceIndex {i + 1}", f"#SequenceHeader >s {'x' * i}", f"#SequenceLength {10**i}bp")]
    for rows in blocks:
        for i, seq in enumerate(rows):
            lines += [f">{i + 1}:{i + 1}-9 {'+-'[i % 2]} c", *(seq[j : j + 70] for j in range(0, len(seq), 70))]
        lines.append("=")
    table = spark.createDataFrame([(f, i // 9, i, x) for f in "ab" for i, x in enumerate(lines)], "file string, block long, at long, line string").repartition(3)
    found = reports.xmfa_to_maf(table)
    texts = {(r["file"], r["block_id"]): r["text"] for r in found.collect()}
    aln = spark.createDataFrame([(b, i, s.upper()) for b, rows in enumerate(blocks) for i, s in enumerate(rows)], "aln_id long, row_idx long, seq string")
    scores = {r["aln_id"]: r["score"] for r in block_scores(window_scores(pair_chunks(aln))).collect()}
    assert set(texts) == {(f, b) for f in "ab" for b in [-1, *scores]}
    for b, score in scores.items():
        shown = [f"s {'s-' + 'x' * i if i else 's':<5}{i + 1:>3} {9 - i:>3} {'+-'[i % 2]} {10**i:>9} {s}" for i, s in enumerate(blocks[b])]
        assert texts["a", b] == texts["b", b] == "\n".join([f"a score={score:.6g}", *shown, ""])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 0


def test_six_digits(spark):
    from strandline.sources.text import six_digits

    values = [0.0, 1.0, -2055.125, 123456789.0, 0.1234565, 1234565.0]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(six_digits(F.col("v"))).collect()]
    assert got[:3] == ["0", "1", "-2055.12"] and got[4] in ("0.123456", "0.123457")
