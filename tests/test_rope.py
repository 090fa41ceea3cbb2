"""Ropes and two-level running sums against plain strings and sums."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.operators import rope, runs, scan
from strandline.sources import datasource

KEYS = ("k",)


def random_edits(rng, n):
    """Disjoint edits of a sequence of n symbols, some of them insertions where an exchange begins or ends."""
    out, at = [], 0
    while at <= n:
        kind = rng.random()
        if kind < 0.3:
            out.append((at, 0, "x" * rng.randint(1, 4)))
        if kind > 0.2 and at < n:
            length = rng.randint(1, min(25, n - at))
            out.append((at, length, "y" * rng.choice([0, 1, length, length])))
            at += length
        at += rng.randint(1, 12)
    return out


def plain(seq, edits):
    out, at = [], 0
    for start, length, value in sorted(edits):
        out += [seq[at:start], value]
        at = start + length
    return "".join(out) + seq[at:]


def made(spark, seqs, edits):
    rows = spark.createDataFrame(list(seqs.items()), "k long, seq string")
    table = spark.createDataFrame([(k, *e) for k, own in edits.items() for e in own], "k long, start long, len long, str_value string")
    return rows, table


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_edits_equal_plain_strings(spark, width):
    rng = random.Random(width)
    seqs = {k: "".join(rng.choice("ACGT") for _ in range(n)) for k, n in enumerate([0, 1, 2, 6, 7, 8, 14, 21, 50, 77, 100])}
    edits = {k: random_edits(rng, len(s)) for k, s in seqs.items() if k != 8}
    rows, table = made(spark, seqs, edits)
    found = rope.edited(rope.to_rope(rows, KEYS, width), table, KEYS, width)
    wanted = {k: plain(s, edits.get(k, [])) for k, s in seqs.items()}
    assert {r["k"]: r["seq"] for r in rope.from_rope(found, KEYS).collect()} == wanted
    even = rope.evened(found, KEYS, 5)
    assert {r["k"]: r["seq"] for r in rope.from_rope(even, KEYS).collect()} == wanted
    assert all(len(r["piece"]) == 5 or r["chunk"] == len(wanted[r["k"]]) // 5 or not wanted[r["k"]] for r in even.collect())


def test_exchanges_of_one_length_keep_the_places_of_later_edits(spark):
    rows, fill = made(spark, {1: "ACGTACGTAC"}, {1: [(1, 7, "nnnnnnn")]})
    _, widen = made(spark, {}, {1: [(5, 0, "--"), (3, 0, "+")]})
    cut = rope.to_rope(rows, KEYS, 3)
    found = rope.edited(rope.edited(cut, fill, KEYS, 3), widen, KEYS, 3)
    assert rope.from_rope(found, KEYS).first()["seq"] == "Ann+nn--nnnAC"


def test_time_is_linear_in_edits_of_one_sequence(spark):
    def seconds(n):
        rows = spark.range(1).select(F.col("id").alias("k"), F.repeat(F.lit("ACGTACGTAC"), n).alias("seq"))
        edits = spark.range(n).select(F.lit(0).cast("long").alias("k"), (F.col("id") * 10 + 3).alias("start"), F.lit(2).cast("long").alias("len"), F.lit("ttt").alias("str_value"))
        began = time.time()
        assert runs.splice(rows, edits, keys=KEYS).select(F.length("seq")).first()[0] == 11 * n
        return time.time() - began

    seconds(1000)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.5)


def test_wrapped_files_of_ropes(spark, tmp_path):
    seqs = {1: "ACGT" * 501, 2: "", 3: "A", 4: "C" * 70, 5: "G" * 71}
    rows, table = made(spark, seqs, {1: [(6, 0, "n" * 500), (1999, 3, "")]})
    names = rows.select("k", F.concat(F.lit("s"), F.col("k")).alias("name"))
    lines = rope.wrapped(rope.edited(rope.to_rope(rows, KEYS), table, KEYS), names, KEYS, 70, lines=3)
    datasource.write_ordered(lines, str(tmp_path / "out"), ["k", "chunk"], partitions=4)
    found = spark.read.format("strandline-fasta").load(str(tmp_path / "out"))
    texts = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))]
    wanted = {f"s{k}": plain(s, [(6, 0, "n" * 500), (1999, 3, "")] if k == 1 else []) for k, s in seqs.items()}
    whole = "".join(texts)
    assert {r.split("\n")[0]: "".join(r.split("\n")[1:]) for r in whole.split(">")[1:]} == wanted
    assert max(len(line) for line in whole.split("\n")) == 70
    assert {r["name"]: r["seq"] for r in found.collect()} == wanted  # the first record goes over several files
    assert len([t for t in texts if not t.startswith(">")]) >= 1


@pytest.mark.parametrize("width", [1, 2, 10, 1 << 16])
@pytest.mark.parametrize("exclusive", [True, False])
def test_running_sums(spark, width, exclusive):
    rng = random.Random(width)
    rows = [(k, at, rng.randint(-5, 9)) for k in range(3) for at in rng.sample(range(60), 25)]
    found = scan.running(spark.createDataFrame(rows, "k long, at long, v long"), ["k"], "at", {"sum": F.col("v"), "n": F.lit(1)}, exclusive, width=width)
    before = lambda k, at: [v for a, b, v in rows if a == k and (b < at if exclusive else b <= at)]
    assert sorted(map(tuple, found.collect())) == sorted((k, at, v, sum(before(k, at)), len(before(k, at))) for k, at, v in rows)


def test_restoration_over_the_borders_of_chunks(spark):
    rng = random.Random(9)
    originals = {i: "".join(rng.choices("ACGTN", (5, 5, 5, 5, 2), k=rng.randint(2200, 2600))) for i in range(3)}
    cores = {i: s.replace("N", "") for i, s in originals.items()}
    gapped = {i: "".join(c + "-" * (rng.random() < 0.2) * rng.randint(1, 3) for c in s) for i, s in cores.items()}
    wide = max(map(len, gapped.values()))
    rows = spark.createDataFrame([(0, i, s.ljust(wide, "-")) for i, s in gapped.items()], "aln_id long, row_idx long, seq string")
    n = runs.symbol_runs(spark.createDataFrame([(0, i, s) for i, s in originals.items()], "aln_id long, row_idx long, seq string"), "N")
    found = {r["row_idx"]: r["seq"] for r in runs.restore_unknown(rows, n).collect()}
    assert {i: s.replace("-", "") for i, s in found.items()} == originals
    assert len({len(s) for s in found.values()}) == 1 and len(found[0]) > wide
