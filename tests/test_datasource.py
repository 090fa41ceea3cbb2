"""Readers by byte ranges, the stream reader and the ordered writer."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.sources import datasource, formats
from strandline.sources.text import read_lines


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    datasource.register(spark)


def fasta(spark, path, **options):
    return spark.read.format("strandline-fasta").options(**options).load(str(path))


FASTA = "junk\nmore junk\n" + "".join(f">r{i} d e\r\n" + "".join(f"{'ACGTN'[:i % 6]}{j}\n" for j in range(i % 4)) + "\n" * (i % 3) for i in range(60)) + ">last\nAC GT \nG"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 10**6])
def test_fasta_equals_the_line_parser_for_every_range(spark, tmp_path, size):
    (tmp_path / "x.fa").write_text(FASTA)
    found = datasource.number_records(fasta(spark, tmp_path, bytes=str(size))).select("seq_idx", "name", "seq")
    wanted = formats.parse_fasta(read_lines(spark, str(tmp_path))).select("seq_idx", "name", "seq")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("text", ["", "\n\n", "no record", ">", ">a", ">a\n", ">a\n>b\n>c", "\n>a\nAC"])
@pytest.mark.parametrize("size", [1, 2, 100])
def test_small_files(spark, tmp_path, text, size):
    (tmp_path / "x.fa").write_text(text)
    found = sorted((r["name"], r["seq"]) for r in fasta(spark, tmp_path, bytes=str(size)).collect())
    assert found == sorted((r["name"], r["seq"]) for r in formats.parse_fasta(read_lines(spark, str(tmp_path))).collect())


def test_one_large_file_has_many_partitions(spark, tmp_path):
    (tmp_path / "x.fa").write_text(FASTA)
    assert fasta(spark, tmp_path, bytes="200").rdd.getNumPartitions() == -(-len(FASTA) // 200)


def test_filters_on_names_are_taken_over_and_columns_pruned(spark, tmp_path, capsys):
    (tmp_path / "x.fa").write_text(FASTA)
    two = fasta(spark, tmp_path, bytes="300").where(F.col("name").isin("r7 d e", "r9 d e") & F.col("name").startswith("r7") & (F.length("seq") > 0))
    assert [r["name"] for r in two.collect()] == ["r7 d e"]
    two.explain("formatted")
    plan = capsys.readouterr().out
    assert "Filter" in plan and "isin" not in plan.lower().replace("in (", "isin") or "StartsWith" not in plan.split("Filter")[-1]
    names = spark.read.format("strandline-fasta").schema("name string").load(str(tmp_path))
    assert names.columns == ["name"] and names.count() == 61


@pytest.mark.parametrize("size", [1, 5, 33, 10**6])
def test_fastq_with_qualities_that_look_like_headers(spark, tmp_path, size):
    rng = random.Random(3)
    records = [(f"r {i}", "ACGTN"[: 1 + i % 5] * (i % 7), "".join(rng.choice("@+I>") for _ in range((1 + i % 5) * (i % 7)))) for i in range(40)]
    (tmp_path / "x.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records))
    found = datasource.number_records(spark.read.format("strandline-fastq").option("bytes", str(size)).load(str(tmp_path)))
    assert [(r["name"], r["seq"], r["quality"]) for r in found.orderBy("seq_idx").collect()] == records


def test_stream_reads_new_files_once(spark, tmp_path):
    folder, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("strandline-fasta").option("bytes", "5").load(str(folder))
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)

    (folder / "a.fa").write_text(">a\nAC\nGT\n>b\nTT\n")
    run()
    (folder / "c.fa").write_text(">c\nGG\n")
    run()
    run()
    assert sorted((r["name"], r["seq"]) for r in spark.read.parquet(sink).collect()) == [("a", "ACGT"), ("b", "TT"), ("c", "GG")]


def test_ordered_files_hold_rows_in_order(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit(">s"), F.col("id"), F.lit("\nACGT")).alias("text")).orderBy(F.rand(1))
    path = str(tmp_path / "out")
    datasource.write_ordered(rows.repartition(7), path, ["k"], partitions=5)
    listed = json.loads((tmp_path / "out" / "_files.json").read_text())
    assert len(listed) > 1 and sum(f["rows"] for f in listed) == 500
    text = "".join((tmp_path / "out" / f["file"]).read_text() for f in listed)
    assert text == "".join(f">s{i}\nACGT\n" for i in range(500))
    found = datasource.number_records(fasta(spark, path, bytes="64"), whole_set=True)
    assert [r["name"] for r in found.orderBy("seq_idx").collect()] == [f"s{i}" for i in range(500)]
    datasource.write_ordered(rows.where("k < 3"), path, ["k"])
    assert fasta(spark, path).count() == 503
    datasource.write_ordered(rows.where("k < 2"), path, ["k"], mode="overwrite")
    assert sorted(r["name"] for r in fasta(spark, path).collect()) == ["s0", "s1"]
    assert sorted(p.name[:5] for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["_file", "part-"]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("text")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        bad.select("text").write.format("strandline-text").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_an_empty_write_is_an_empty_set(spark, tmp_path):
    datasource.write_ordered(spark.range(0).select("id", F.lit("x").alias("text")), str(tmp_path / "out"), ["id"])
    assert json.loads((tmp_path / "out" / "_files.json").read_text()) == [] and fasta(spark, tmp_path / "out").count() == 0
