"""Literal cases of each operator."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import columns, composition, extension, kmers, pairs, runs, segments, simulate, summaries, tiles, windows
from strandline.operators.columns import cells, pair_cells, pair_chunks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def aln(spark, *rows):
    return spark.createDataFrame([(0, i, s) for i, s in enumerate(rows)], "aln_id long, row_idx long, seq string")


def test_sequence_functions(spark):
    s = F.col("s")
    assert one(spark, S.normalise(s), s="acgu:x-n") == "ACGTNN-N"
    assert one(spark, S.reverse_complement(s), s="AACGTn") == "nACGTT"
    assert one(spark, S.decode(S.encode(s)), s="ACGTNX-u") == "ACGTNN-T"
    assert one(spark, S.clean_markers(s), s="a1>2<") == "aac"
    assert one(spark, S.header(s, dashes=True), s="> a b \r") == "a-b"
    assert one(spark, S.wrap(s, 2), s="ACGTA") == "AC\nGT\nA"
    assert one(spark, S.strip_space(s), s="A C\tG") == "ACG"
    assert [one(spark, S.hoxd70(F.col("a"), F.col("b")), a=a, b=b) for a, b in ("AA", "TA", "CG", "AN", "--")] == [91, -123, -125, 0, 0]


def test_sum_of_pairs(spark):
    rows = cells(aln(spark, "AC-N", "AG-A", "ATCN"))
    got = composition.sp_scores(rows).first()
    assert (got["sp"], round(got["avg_sp"], 6), round(got["scaled_sp"], 6)) == (-4, -1.333333, -0.333333)


def test_sum_of_pairs_equals_explicit_pairs(spark):
    seqs = ["AC-NGT", "AG-A-T", "ATCNN-", "-TCNGA"]

    def cost(x, y):
        bases = "ACGT"
        if x in bases and y in bases:
            return 1 if x == y else -1
        return -2 if {x, y} - {"-"} and "-" in (x, y) else 0

    wanted = sum(cost(a[p], b[p]) for i, a in enumerate(seqs) for b in seqs[:i] for p in range(6))
    assert composition.sp_scores(cells(aln(spark, *seqs))).first()["sp"] == wanted


def test_identity(spark):
    assert tiles.pair_identities(aln(spark, "acg-t", "ACC-T")).first()["identity"] == 0.8
    assert tiles.pair_identities(aln(spark, "", "")).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        tiles.pair_identities(aln(spark, "AC", "A")).collect()


def test_tiles_of_deep_alignments(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choices("ACGTacgtn-", k=2100)) for _ in range(tiles.ROWS * 2 + 3)]
    found = {(r["i"], r["j"]): r["identity"] for r in tiles.pair_identities(aln(spark, *seqs)).collect()}
    assert len(found) == len(seqs) * (len(seqs) - 1) // 2
    for i, j in [(0, 1), (0, 64), (63, 64), (5, 130), (128, 129), (64, 127)]:
        assert found[i, j] == sum(x == y for x, y in zip(seqs[i].lower(), seqs[j].lower())) / 2100


def test_runs_and_their_return(spark):
    rows = aln(spark, "NNACNGN")
    found = runs.symbol_runs(rows, "N")
    assert sorted((r["idx"], r["number"]) for r in found.collect()) == [(0, 2), (2, 1), (3, 1)]
    core = rows.withColumn("seq", S.strip_n(F.col("seq")))
    assert core.first()["seq"] == "ACG"
    assert runs.insert_runs(core, found, "N").first()["seq"] == "NNACNGN"


def test_restore_unknown(spark):
    n = spark.createDataFrame([(0, 0, 2, 3), (0, 1, 0, 1), (0, 1, 5, 2)], "aln_id long, row_idx long, idx long, number long")
    got = {r["row_idx"]: r["seq"] for r in runs.restore_unknown(aln(spark, "AC-GT", "ACCGT"), n).collect()}
    assert got == {0: "-ACNNNGT--", 1: "NACC--GTNN"}


def test_segments(spark):
    pair = pair_cells(aln(spark, "ACGT-ACG", "AC-TTACG")).where("row_idx = 1")
    found = segments.ungapped_segments(pair)
    assert sorted((r["s1"], r["s2"], r["e1"], r["e2"]) for r in found.collect()) == [(0, 0, 1, 1), (3, 2, 3, 2), (4, 4, 6, 6)]
    merged = segments.ungapped_segments(pair, 3)
    assert [(r["s1"], r["s2"], r["e1"], r["e2"]) for r in merged.collect()] == [(0, 0, 6, 6)]


def test_exact_blocks_reach_the_end(spark):
    found = segments.exact_match_blocks(cells(aln(spark, "ACGT-A", "ACCT-A")), 1)
    assert sorted((r["start"], r["length"]) for r in found.collect()) == [(0, 2), (3, 1), (5, 1)]


def test_block_score(spark):
    scored = windows.window_scores(pair_chunks(aln(spark, "ACGT-A", "A--TCA", "ACGTNA")))
    assert [r["score"] for r in windows.row_scores(scored).orderBy("row_idx").collect()] == [73, -557, 73]
    assert windows.block_scores(scored).first()["score"] == -137.0


def plain_segment(x, y):
    """The walk over columns that defines the segment."""
    best, run, begin, found = 0, 0, 0, (None, None, None)
    for i, (p, q) in enumerate(zip(x, y)):
        run += -2 if "-" in (p, q) else 0 if "N" in (p, q) else 1 if p == q else -2
        if run > best:
            best, found = run, (run, begin, i)
        if run < 0:
            run, begin = 0, i + 1
    return found


def plain_affine(x, y):
    score, gap = 0, False
    for p, q in zip(x, y):
        if p == q == "-":
            continue
        gapped = "-" in (p, q)
        score += (-1 if gap else -2) if gapped else 0 if "N" in (p, q) else 1 if p == q else -1
        gap = gapped
    return score


@pytest.mark.parametrize("width", [1, 2, 7, 1000])
def test_summaries_of_chunks_add_up(spark, width):
    rng = random.Random(width)
    given = [("AACGTTA", "TACGTNA"), ("AA", "CC"), ("", ""), ("-", "-"), ("A", "A"), ("--AC", "--AG")]
    given += [tuple("".join(rng.choices("ACGTN-", (9, 2, 2, 2, 1, 3), k=n)) for _ in range(2)) for n in range(40)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(given)], "k long, a string, b string")
    chunks = summaries.pair_parts(rows, "k", width=width)
    found = {r["k"]: (r["score"], r["start"], r["stop"]) for r in summaries.best_segments(chunks, ["k"], width=width).collect()}
    assert found == {i: plain_segment(a, b) for i, (a, b) in enumerate(given)} and found[0] == (5, 1, 6)
    scores = {r["k"]: (r["score"], r["matches"]) for r in summaries.affine_scores(chunks, ["k"], 1, -1, -2, -1).collect()}
    assert scores == {i: (plain_affine(a, b), sum(p == q and p not in "N-" for p, q in zip(a, b))) for i, (a, b) in enumerate(given)}


def test_shared_kmers(spark):
    seq1 = "GGATTACAGGCATGCACCACCATGCCCGGCTAATTTTTGTATTTTTAGTA"
    got = {r["row_idx"]: (r["n_kmers"], r["n_shared"]) for r in kmers.shared_kmers(aln(spark, seq1, seq1[:20] + "AC", "CCC"), 5).collect()}
    assert got[0] == (46, 46) and got[1][0] == 18 and got[1][1] >= 16 and 2 not in got


def test_greedy_seeds(spark):
    ref = spark.createDataFrame([(0, "ACGTACGGTTCA")], "ref_idx long, seq string")
    q = spark.createDataFrame([(0, 1, "CGGTTNACGTA")], "ref_idx long, query_idx long, seq string")
    got = sorted((r["query_pos"], r["ref_pos"], r["length"]) for r in kmers.greedy_seeds(q, ref, 4).collect())
    assert got == [(0, 5, 5), (6, 0, 5)]


def test_walks_by_doubled_pointers(spark):
    rng = random.Random(6)
    walks = {k: {p: rng.randint(1, 30) for p in rng.sample(range(1200), n)} for k, n in enumerate([1, 2, 3, 50, 300, 1100])}
    rows = [(k, p, n) for k, own in walks.items() for p, n in own.items()]
    wanted = set()
    for k, own in walks.items():
        at = 0
        for p in sorted(own):
            if p >= at:
                wanted.add((k, p))
                at = p + own[p]
    found = kmers.walked(spark.createDataFrame(rows, "k long, query_pos long, length long"), ["k"]).collect()
    assert len(found) == len(wanted) and set(map(tuple, found)) == wanted


def test_edits_and_liftover(spark):
    ref = spark.createDataFrame([(0, "AACCGGTT")], "seq_idx long, seq string")
    edits = spark.createDataFrame([(0, "INSERT", 2, 0, "tt"), (0, "EXCHANGE", 4, 2, "")], "seq_idx long, kind string, start long, len long, str_value string")
    assert simulate.apply_edits(ref, edits).first()["seq"] == "AAttCCTT"
    points = spark.createDataFrame([(0, p) for p in range(8)], "seq_idx long, pos long")
    assert [r["lifted"] for r in simulate.liftover(points, edits).orderBy("pos").collect()] == [0, 1, 4, 5, 6, 6, 6, 7]


def test_structural_variants_keep_their_promises(spark):
    ref = simulate.random_sequences(spark.createDataFrame([(5,)], "seq_idx long"), 800)
    variants = simulate.place_variants(ref, {simulate.TANDEM: (2, 30), simulate.INVERSION: (2, 30), simulate.TRANSLOCATION: (1, 30), simulate.SMALL_SUBSTITUTE: (2, 1)})
    edits = simulate.variant_edits(variants, ref).collect()
    assert len({e["sv_id"] for e in edits}) == 7
    taken = sorted((e["start"], e["start"] + e["len"]) for e in edits if e["len"])
    assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
    seq = ref.first()["seq"]
    for e in edits:
        if e["sv_type"] == simulate.SMALL_SUBSTITUTE:
            assert e["str_value"] != seq[e["start"]] and len(e["str_value"]) == 1
    got = simulate.apply_edits(ref, simulate.variant_edits(variants, ref)).first()["seq"]
    assert len(got) == 800 + 2 * 30


def test_aligned_samples(spark):
    ref = simulate.balanced_sequences(spark.createDataFrame([(1,)], "seq_idx long"), 101)
    seq = ref.first()["seq"]
    assert [seq.count(b) for b in "ACGT"] == [25, 25, 26, 25]
    rows = {r["sample"]: r["seq"] for r in simulate.aligned_samples(ref, 4, 6, 3, 5).collect()}
    assert len({len(s) for s in rows.values()}) == 1 and rows[0].replace("-", "") == seq
    for s in (1, 2, 3):
        pairs_ = [(a, b) for a, b in zip(rows[0], rows[s]) if a != "-"]
        assert sum(b == "-" for _, b in pairs_) == 5 and sum(a != b and b != "-" for a, b in pairs_) == 6
        assert sum(a == "-" and b != "-" for a, b in zip(rows[0], rows[s])) == 3


def test_extension_grows_and_fuses():
    sheet = extension.Sheet({0: "ACGT" * 60, 1: "ACGT" * 60})
    own = sum(S.HOXD70[c + c] for c in "ACGT" * 25)
    first, second = extension.Block(20, 120, (0, 1), own, own), extension.Block(130, 220, (0, 1), own, own)
    got = extension.extend_all(sheet, [first, second])
    assert [(b.start, b.end) for b in got] == [(0, 240)]


def test_extension_stops_at_gaps():
    sheet = extension.Sheet({0: "A" * 100 + "C" * 40, 1: "A" * 100 + "-" * 40})
    block = extension.Block(0, 100, (0, 1), 9100.0, 9100.0)
    assert extension.extended(sheet, block, extension.np.arange(100, 140), 1.0).end == 101


def taken_by_definition(seqs, block, columns, share):
    """The largest number of columns whose every prefix holds the share, cut back to the first column of a piled stretch."""
    step = 1 if columns and columns[0] >= block.end else -1

    def cost(c):
        total = 0
        for r in block.rows:
            edge = block.end - 1 if step > 0 else block.start
            gap = "-" in (seqs[r][c], seqs[0][c])
            before = seqs[r][edge] == "-" if c - step == edge else "-" in (seqs[r][c - step], seqs[0][c - step])
            pair = "".join(sorted(seqs[r][c] + seqs[0][c]))
            total += (S.GAP_EXTEND if before else S.GAP_OPEN) if gap else S.HOXD70.get(pair, 0)
        return total / len(block.rows)

    for n in range(1, len(columns) + 1):
        width = block.width + n
        mean = (block.score * block.width + 100 * sum(cost(c) for c in columns[:n])) / width
        full = (block.score_100 * block.width + 100 * sum(S.HOXD70.get(seqs[0][c] * 2, 0) for c in columns[:n])) / width
        if mean < full * share / 100:
            return n - 1
        stretch = []
        for c in reversed(columns[:n]):
            if not any(seqs[r][c] == "-" for r in block.rows):
                break
            stretch.append(c)
        gaps = [sum(seqs[r][c] == "-" for c in stretch) for r in block.rows]
        if stretch and (max(gaps) >= 5 or (len(stretch) >= 5 and sum(gaps) >= len(stretch) * len(block.rows) // 2)):
            return n - len(stretch) + 1
    return len(columns)


def test_extension_equals_its_definition():
    draw = random.Random(4)
    for _ in range(150):
        n, k = draw.randint(20, 60), draw.randint(1, 4)
        base = [draw.choice("ACGT") for _ in range(n)]
        seqs = {r: "".join("-" if draw.random() < 0.2 else c if draw.random() < 0.9 else draw.choice("ACGTN") for c in base) for r in range(k)}
        start = draw.randint(0, n - 2)
        block = extension.Block(start, draw.randint(start + 1, n - 1), tuple(sorted(draw.sample(range(k), draw.randint(1, k)))), draw.uniform(-500, 9000), 9000.0)
        share = draw.choice([98.0, 10.0, -100.0])
        for columns in (list(range(block.end, n)), list(range(block.start - 1, -1, -1))):
            got = extension.extended(extension.Sheet(seqs), block, extension.np.array(columns, dtype=int), share)
            assert got.width - block.width == taken_by_definition(seqs, block, columns, share)


def test_histogram_of_one_value(spark):
    got = pairs.histogram(spark.createDataFrame([(3,), (3,)], "v int"), "v").collect()
    assert [(r["bin"], r["n"]) for r in got] == [(10, 2)]


def test_truth_rows_agree(spark):
    ref = simulate.random_sequences(spark.createDataFrame([(2,), (3,)], "seq_idx long"), 900)
    wanted = {t: (1, 25) for t in (simulate.TANDEM, simulate.DISPERSED, simulate.INVERTED_DUPLICATION, simulate.TRANSLOCATION, simulate.INVERSION, simulate.INVERTED_TRANSLOCATION, simulate.BIG_DELETE, simulate.BIG_INSERT)}
    for variants in (simulate.place_variants(ref, wanted), simulate.variants_by_rate(ref, {t: (0.01, 25) for t in wanted})):
        rows = simulate.truth_rows(variants, simulate.variant_edits(variants, ref), ref).collect()
        assert len(rows) >= 12
        found = {(r["seq_idx"], r["sv_id"]): [x for x in rows if (x["seq_idx"], x["sv_id"]) == (r["seq_idx"], r["sv_id"])] for r in rows}
        for own in found.values():
            by = {r["name"]: r for r in own}
            assert len(own) == 3 and by["simulated"]["seq"] == by["expected"]["seq"] and len(by["reference"]["seq"]) == 25


def test_inverted_blocks(spark):
    rows = spark.createDataFrame([(0, 1, "TTACGTCA-G", "GGACGTCATT")], "aln_id long, row_idx long, a string, b string")
    got = segments.inverted_blocks(rows, 3).first()
    assert (got["a_start"], got["a_len"], got["b_start"], got["b_len"], got["score"]) == (2, 6, 2, 6, 6)
    assert segments.inverted_blocks(rows, 6).count() == 0


def test_chunks_meet_at_their_edges(spark, monkeypatch):
    """Short chunks give what one chunk gives."""
    draw = random.Random(6)
    base = [draw.choice("ACGT") for _ in range(60)]
    rows = ["".join("-" if draw.random() < 0.15 else c if draw.random() < 0.95 else draw.choice("ACGTN") for c in base) for _ in range(3)]
    table = aln(spark, *rows)
    ask = {
        "composition": lambda: composition.composition(cells(table)),
        "matches": lambda: segments.exact_match_rows(table),
        "segments": lambda: segments.ungapped_segments(pair_cells(table), 2),
        "scores": lambda: windows.row_scores(windows.window_scores(pair_chunks(table))),
        "gaps": lambda: windows.gap_columns(cells(table)),
    }
    whole = {k: sorted(map(tuple, f().collect())) for k, f in ask.items()}
    monkeypatch.setattr(columns, "CHUNK", 7)
    assert {k: sorted(map(tuple, f().collect())) for k, f in ask.items()} == whole
    for start, length, row in {(r[1], r[2], r[3]) for r in whole["matches"]}:
        assert len({r[start : start + length] for r in rows}) == 1 and "-" not in rows[0][start : start + length]
    assert all(r[4] == len(rows[r[3]][: r[1]].replace("-", "")) for r in whole["matches"])


def test_kmers_over_short_and_long_sequences(spark, monkeypatch):
    draw = random.Random(8)
    seqs = ["".join(draw.choice("ACGT") for _ in range(n)) for n in (0, 3, 64, 65, 127, 128, 200)]
    table = spark.createDataFrame(list(enumerate(seqs)), "seq_idx long, seq string")
    for k, every in ((4, 1), (4, 4), (70, 1), (9, 2)):
        got = sorted(map(tuple, kmers.kmers(table, k, "seq_idx", every=every).collect()))
        assert got == sorted((i, p, s[p : p + k]) for i, s in enumerate(seqs) for p in range(0, len(s) - k + 1, every))


def test_reads_map_on_both_strands(spark):
    draw = random.Random(9)
    reference = "".join(draw.choice("ACGT") for _ in range(400))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [reference[50:120], turn(reference[200:260]), "ACGT" * 3]
    got = kmers.map_reads(spark.createDataFrame(list(enumerate(reads)), "read_idx long, seq string"), spark.createDataFrame([(7, reference)], "ref_idx long, seq string"), 20).collect()
    assert {tuple(r) for r in got} == {(0, "+", 7, 50, 0, 70), (1, "-", 7, 200, 0, 60)}
    repeated = spark.createDataFrame([(1, "A" * 40)], "ref_idx long, seq string")
    poly = spark.createDataFrame([(0, "A" * 22)], "read_idx long, seq string")
    assert len(kmers.map_reads(poly, repeated, 20).collect()) == 19
    assert kmers.map_reads(poly, repeated, 20, unique=True).where("strand = '+'").collect() == []


def test_liftover_inside_edits(spark):
    edits = spark.createDataFrame([(1, "INSERT", 3, 0, "xx"), (1, "EXCHANGE", 5, 4, "yyyyyy"), (1, "EXCHANGE", 12, 3, ""), (1, "INSERT", 20, 0, "z")], "seq_idx long, kind string, start long, len long, str_value string")
    points = spark.createDataFrame([(1, p) for p in range(22)] + [(2, 5)], "seq_idx long, pos long")
    got = {(r["seq_idx"], r["pos"]): r["lifted"] for r in simulate.liftover(points, edits).collect()}
    assert got[2, 5] == 5
    for p in range(22):
        added = 2 * (p >= 3) + (p >= 20) + (min(6, p - 5) if 5 < p < 9 else 6 * (p >= 9))
        gone = max(0, min(p - 5, 4)) + max(0, min(p - 12, 3))
        assert got[1, p] == p + added - gone


def test_named_restoration_checks_names_and_lengths(spark):
    records = spark.createDataFrame([(0, 0, "a", 4, 2, 3), (0, 1, "b", 5, 0, 1)], "aln_id long, seq_idx long, name string, length long, idx long, number long")
    rows = lambda *r: spark.createDataFrame([(0, *x) for x in r], "aln_id long, name string, seq string")
    got = {r["name"]: (r["row_idx"], r["seq"]) for r in runs.restore_named(rows(("b", "ACCGT"), ("a", "AC-GT")), records).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 0, "b": 1} and got["a"][1].replace("-", "") == "ACNNNGT" and got["b"][1].replace("-", "") == "NACCGT"
    with pytest.raises(Exception, match="no record of sequence c"):
        runs.restore_named(rows(("c", "AC")), records)
    with pytest.raises(Exception, match="another length than sequence a"):
        runs.restore_named(rows(("a", "AC")), records)
