"""Files that arrive between two runs of a stream are parsed once each."""

from strandline.sources import formats
from strandline.streaming.files import parse_folder


def test_new_files_are_parsed_once(spark, tmp_path):
    folder, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a\nAC\nGT\n>b\nTT\n")
    parse_folder(spark, folder, formats.parse_fasta, sink, state).awaitTermination(60)
    (tmp_path / "in" / "c.fa").write_text(">c\r\nGG\r\n")
    parse_folder(spark, folder, formats.parse_fasta, sink, state).awaitTermination(60)
    got = spark.read.parquet(sink).collect()
    assert sorted((r["name"], r["seq"]) for r in got) == [("a", "ACGT"), ("b", "TT"), ("c", "GG")]


def test_a_repeated_batch_is_there_once(spark, tmp_path):
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a\nAC\n")
    for state in ("one", "two"):  # another checkpoint knows nothing of the first run
        parse_folder(spark, folder, formats.parse_fasta, sink, str(tmp_path / state)).awaitTermination(60)
    assert [(r["name"], r["batch"]) for r in spark.read.parquet(sink).collect()] == [("a", 0)]
