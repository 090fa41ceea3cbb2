"""Steps that hold a bounded number of rows in a task, against the plain forms of the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import columns, composition, segments, windows


def alignment(spark, *seqs, aln_id=1):
    return spark.createDataFrame([(aln_id, i, s) for i, s in enumerate(seqs)], "aln_id long, row_idx long, seq string")


def wide(spark):
    """Alignments over several stretches, with other letters, an uneven one and a single row."""
    a, b = "ACGTN-ACGT" * 230, "ACGTA-TCGT" * 230
    return alignment(spark, a, b, a).union(alignment(spark, "ACé-N", "ACè-N", aln_id=2)).union(alignment(spark, "ACG", "ACGTT", aln_id=3)).union(alignment(spark, "N-A", aln_id=4)).union(alignment(spark, "", None, aln_id=5))


def same(found, wanted):
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.select(*found.columns).collect()), key=str)


def test_columns_are_counted_as_they_pass(spark):
    table = wide(spark).repartition(3)
    counted = composition.column_counts(table)
    assert "Aggregate" not in counted._jdf.queryExecution().executedPlan().toString()  # no group a column
    same(counted, composition.composition(columns.cells(table)))
    same(composition.sp_scores(counted), composition.sp_scores(columns.cells(table)))
    same(windows.gap_columns(counted), windows.gap_columns(columns.cells(table)))
    for least in (1, 3):
        same(segments.exact_match_blocks(table, least), segments.exact_match_blocks(columns.cells(table), least))
    assert composition.column_counts(table.limit(0)).collect() == []


def test_segments_of_chunks(spark):
    """Runs over several chunks, at edges, of one chunk, none at all; against cells."""
    rows = ["A" * 3500, "A" * 1000 + "-" + "C" * 2499, "-" * 1000 + "A" * 1500 + "-" * 1000, "A" * 999 + "-" + "A" * 2500, "-" * 3500, "AC-GT" * 700]
    table = alignment(spark, *rows).union(alignment(spark, *(r[:2000] for r in reversed(rows[:4])), aln_id=2)).union(alignment(spark, "-", "A", aln_id=3)).repartition(4)
    for tolerance in (0, 2, 3):
        same(segments.ungapped_segments(columns.pair_chunks(table), tolerance), segments.ungapped_segments(columns.pair_cells(table), tolerance))
    totals = table.select("aln_id", "row_idx", F.length(F.replace("seq", F.lit("-"), F.lit(""))).alias("n"))
    assert segments.pair_segments(columns.pair_chunks(table)).join(totals, ["aln_id", "row_idx"]).where("n <> total").isEmpty()


def test_six_digits_of_the_number_itself(spark):
    """Numbers next to ties, whose product with a power of ten is a tie, and exact ties."""
    import duckdb

    from strandline.sources.text import six_digits

    values = [(a * 2 + 1) / 2 / 10**e for e in (1, 3, 6, 9) for a in range(100000, 101500)] + [0.5859375, 1234565.0, 1e-7, 3e20, 0.0]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").coalesce(1).select(six_digits(F.col("v"))).collect()]
    wanted = [duckdb.execute("SELECT format('{:.6g}', ?::DOUBLE)", [v]).fetchone()[0] for v in values[::7] + values[-5:]]
    assert got[: len(values)][::7] + got[-5:] == wanted


def test_least_draws_and_hits(spark):
    from pyspark.sql import Window

    from strandline.operators import draws, simulate

    seqs = spark.createDataFrame([(1, "ACGé-" * 700), (-5, "ACGTNACG"), (7, ""), (8, None), (3_000_000, "N" * 1001)], "seq_idx long, seq string").repartition(2)
    cells = columns.cells(seqs, "seq_idx")
    number = simulate.draw(F.col("seq_idx") + 1, F.col("pos"), 3)
    rank = F.row_number().over(Window.partitionBy("seq_idx").orderBy(number, "pos"))
    found = draws.least_draws(seqs, ["seq_idx"], 9, F.col("seq_idx") + 1, 3)
    assert "posexplode(split" not in found._jdf.queryExecution().executedPlan().toString()
    same(found, cells.withColumn("rank", rank).where("rank <= 9"))
    chances = [(20, 2**26), (21, 2**25)]
    kind = F.when(simulate.draw(F.col("seq_idx") + 1, F.col("pos"), 20) < 2**26, 0).when(simulate.draw(F.col("seq_idx") + 1, F.col("pos"), 21) < 2**25, 1)
    total = seqs.select("seq_idx", F.length("seq").alias("total"))
    same(draws.hits(total, chances, 1), cells.join(total.withColumn("total", F.col("total").cast("long")), "seq_idx").withColumn("nth", kind.cast("long")).where("nth is not null"))


def test_kmer_hits_inside_references(spark, monkeypatch):
    """Many small references at a time, one dealt to several shares, pieces with edges, letters without a code; against a join."""
    import random

    from strandline.operators import kmers, matching

    pick = random.Random(3)
    text = lambda n, of="ACGTN": "".join(pick.choices(of, k=n))
    base = text(700)
    reference = spark.createDataFrame([(1, base), (2, text(60)), (3, "acgtACGT" * 9), (4, ""), (5, "A" * 40)], "ref_idx long, seq string")
    queries = spark.createDataFrame([(1, 1, base[90:400] + text(50)), (1, 2, text(300)), (2, 1, text(900, "AC")), (3, 1, "tACGTacgt" * 5), (4, 1, base), (5, 2, "A" * 30), (6, 1, base)], "ref_idx long, query_idx long, seq string").repartition(3)
    for share, piece, together in ((1 << 22, 1 << 16, 1 << 20), (100, 64, 50)):
        monkeypatch.setattr(matching, "SHARE", share)
        monkeypatch.setattr(matching, "PIECE", piece)
        for k in (4, 15):
            same(kmers.kmer_hits(queries, reference, k), kmers._joined_hits(queries, reference, k))


def test_plans_of_the_allocator_do_not_grow_with_its_rounds(spark):
    """All requests draw the first free place, so each round settles one."""
    from strandline.operators.allocate import TABLES, allocate

    n = 10
    totals = spark.createDataFrame([(1, n)], "seq_idx long, total long")
    requests = spark.createDataFrame([(1, i, 1) for i in range(n)], "seq_idx long, rank long, width long")
    placed = allocate(totals, requests, ["seq_idx"], lambda turn: F.lit(0).cast("long"))
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= TABLES
    assert sorted((r["rank"], r["start"]) for r in placed.collect()) == [(i, i) for i in range(n)]


def test_restoration_by_chunks_of_columns(spark):
    """Rows over several chunks, runs at edges, in gaps and beyond them, letters that are no ASCII; against letters one by one."""
    import random
    import re

    from strandline.operators import runs

    pick = random.Random(5)
    table = {(a, r): "".join(pick.choices("ACGT-", weights=[3, 3, 3, 3, 4], k=w)) for a, w in ((1, 2500), (2, 1000), (3, 3), (4, 1001)) for r in range(3)} | {(5, 0): "---", (6, 0): "Aé-C", (6, 1): "-C-A"}
    found = [(a, r, i, pick.randint(1, 5)) for (a, r), s in table.items() for i in range(len(s.replace("-", "")) + 1) if pick.random() < 0.3] + [(2, 1, 0, 2500), (5, 0, 0, 5)]
    number = {(a, r, i): n for a, r, i, n in found}

    def plain(aln_id):
        needs, parts = {}, {}
        for (a, r), s in table.items():
            if a != aln_id:
                continue
            own, idx = [], 0  # runs of gaps, also empty ones, before each letter
            for part in re.findall(r"-*[^-]|-+$|$", s):
                gaps = len(part) - len(part.lstrip("-"))
                n = number.get((a, r, idx), 0)
                own.append(("N" * min(n, gaps) + "-" * (gaps - n), max(n - gaps, 0), part[gaps:]))
                idx += 1
            parts[r], c = own, 0
            for filled, left, letter in own:
                c += len(filled)
                if left:
                    needs[c] = max(needs.get(c, 0), left)
                c += len(letter)
        out = {}
        for r, own in parts.items():
            text, lefts = "", {}
            for filled, left, letter in own:
                text += filled
                lefts[len(text)] = lefts.get(len(text), 0) + left
                text += letter
            out[r] = "".join("N" * lefts.get(c, 0) + "-" * (needs.get(c, 0) - lefts.get(c, 0)) + text[c : c + 1] for c in range(len(text) + 1))
        return out

    aligned = spark.createDataFrame([(*k, s) for k, s in table.items()], "aln_id long, row_idx long, seq string").repartition(3)
    n_runs = spark.createDataFrame(sorted({(a, r, i): (a, r, i, n) for a, r, i, n in found}.values(), key=lambda _: pick.random()), "aln_id long, row_idx long, idx long, number long").repartition(4)
    restored = runs.restore_unknown(aligned, n_runs)
    assert "Join" not in restored._jdf.queryExecution().executedPlan().toString()  # no table of edits
    assert {(x.aln_id, x.row_idx): x.seq for x in restored.collect()} == {(a, r): s for a in range(1, 7) for r, s in plain(a).items()}
    block = F.struct("aln_id", F.lit("x").alias("other")).alias("aln_id")
    same(runs.restore_unknown(aligned.withColumn("aln_id", block), n_runs.withColumn("aln_id", block)).select("aln_id.aln_id", "row_idx", "seq"), restored)
    runs_ = runs.symbol_runs(restored, "N")
    assert "Window" not in runs_._jdf.queryExecution().executedPlan().toString()


def test_rows_that_carry_their_runs_meet_none(spark, small_dir):
    """Runs beside rows, over several chunks and without any, against a table of runs; the queries' letters pass two exchanges."""
    from strandline.operators import runs
    from strandline.plans import queries

    own = alignment(spark, "ACGT" * 700, "NNAC-GTN" * 300 + "N", "NNN").union(alignment(spark, "ACNNGé", "N" * 1500 + "A", aln_id=2)).union(alignment(spark, "", "N", aln_id=3)).repartition(3)
    core = F.replace("seq", F.lit("N"), F.lit(""))
    carrying = runs.with_runs(own).select("aln_id", "row_idx", F.rpad(core, 3000, "-").alias("seq"), "n_runs")
    apart = carrying.select("aln_id", "row_idx", F.explode("n_runs").alias("r")).select("aln_id", "row_idx", "r.*")
    same(runs.restore_unknown(carrying), runs.restore_unknown(carrying.drop("n_runs"), apart))
    aligned, found = queries._restorable(spark, small_dir)
    restored = queries.n_restore(spark, small_dir)
    plan = restored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Join" not in plan
    same(restored, runs.restore_unknown(aligned, found))


def test_widths_of_rows_that_carry_their_runs(spark, small_dir):
    """Runs in gaps, beyond them and at both ends, rows of N alone; against runs joined as rows. Only needs are exchanged."""
    from strandline.operators import runs
    from strandline.plans import queries

    own = alignment(spark, "ACGT" * 700, "NNAC-GTN" * 300 + "N", "NNN").union(alignment(spark, "NN", "NNNN", "", aln_id=2)).union(alignment(spark, "é-N", "éNN", None, aln_id=3)).repartition(3)
    carrying = runs.with_runs(own).withColumn("seq", F.replace("seq", F.lit("N"), F.lit("")))
    apart = carrying.select("aln_id", "row_idx", F.explode("n_runs").alias("r")).select("aln_id", "row_idx", "r.*")
    same(runs.carried_widths(carrying), runs.merge_widths(runs.merge_needs(runs.symbol_runs(carrying, "-"), apart)))
    aligned, found = queries._restorable(spark, small_dir)
    widths = queries.n_merge_widths(spark, small_dir)
    plan = widths._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan and "Join" not in plan
    same(widths, runs.merge_widths(runs.merge_needs(runs.symbol_runs(aligned, "-"), found)))


def test_starts_of_matches_without_a_row_for_each_gap(spark):
    """Rows over several chunks, with gaps at edges, other letters, and an uneven one; against prefixes of the rows."""
    from strandline.operators.columns import CHUNK

    a, b = "AC--GTN-" * 400, "AC--GTTT" * 400
    edge = "-" * CHUNK + "A" * CHUNK + "-" * (CHUNK - 1) + "AC"
    tables = {1: [a, b, a], 2: [edge, edge], 3: ["é-ACG", "é-ATG"], 4: ["-A-CG", "-A-CGTT"], 5: ["", ""]}
    table = spark.createDataFrame([(k, i, s) for k, rows in tables.items() for i, s in enumerate(rows)], "aln_id long, row_idx long, seq string").repartition(3)
    for least in (1, 2):
        found = segments.exact_match_rows(table, least)
        windows_of = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Window ")
        assert windows_of(found) == windows_of(segments.exact_match_blocks(table, least))
        wanted = [(k, r.start, r.length, i, len(s[: r.start].replace("-", ""))) for r in segments.exact_match_blocks(table, least).collect() for k in [r.aln_id] for i, s in enumerate(tables[k]) if r.start < len(s)]
        assert len(wanted) > 1000 and sorted(map(tuple, found.collect())) == sorted(wanted)


def test_similarity_of_sets_inside_alignments(spark, monkeypatch):
    """Rows as strings, also dealt to shares and with letters without a code, against joins; an estimate on fewer hashes is near."""
    import random

    from strandline.operators import kmers, matching

    pick = random.Random(7)
    base = "".join(pick.choices("ACGTN", k=9000))
    rows = [base, base[3000:] + "ACGT", "--" + base[:200] + "-", "ACG", ""]
    table = alignment(spark, *rows).union(alignment(spark, "AC", base, aln_id=2)).union(alignment(spark, "ACxé" * 40, "CxéA" * 30, "ACGT" * 9, aln_id=3)).repartition(3)
    for share, piece, together in ((1 << 22, 1 << 16, 1 << 20), (100, 64, 50)):
        monkeypatch.setattr(matching, "SHARE", share)
        monkeypatch.setattr(matching, "PIECE", piece)
        monkeypatch.setattr(matching, "TOGETHER", together)
        for k in (4, 15):
            found = kmers.similarities(table, k)
            same(found.drop("estimate"), kmers._joined_similarity(table, k))
            assert found.where("abs(similarity - estimate) > 0.05").isEmpty()
    plan = kmers.exact_similarity(table.where("aln_id < 3"), 15)._jdf.queryExecution().executedPlan().toString()
    assert "substring" not in plan.split("MapInArrow")[0]  # no row a k-mer
    a, b = np.arange(90_000), np.arange(45_000, 135_000)
    estimate = matching._share_of(a, b, np.isin(a, b))
    assert estimate != 45_000 and abs(estimate / 135_000 - 1 / 3) < 0.05


def test_shared_kmers_inside_alignments(spark, monkeypatch):
    """Rows meet as strings, also dealt to shares, with letters without a code and without a centre; against a join of k-mers."""
    import random

    from strandline.operators import kmers, matching

    pick = random.Random(11)
    base = "".join(pick.choices("ACGTN", k=3000))
    odd = alignment(spark, "ACxé" * 40, "CxéA" * 30, "ACGT" * 9, aln_id=3)
    plain = alignment(spark, base, base[900:] + "ACGT", "--" + base[:200] + "-", "ACG", "").union(alignment(spark, "AC", base, aln_id=2)).union(alignment(spark, "ACGTACGT", "CGTACG", aln_id=4).where("row_idx > 0"))
    plain = plain.union(plain.where("aln_id = 2").selectExpr("cast(null as bigint)", "row_idx", "seq")).repartition(3)
    for share, piece, together in ((1 << 22, 1 << 16, 1 << 20), (100, 64, 50)):
        monkeypatch.setattr(matching, "SHARE", share)
        monkeypatch.setattr(matching, "PIECE", piece)
        monkeypatch.setattr(matching, "TOGETHER", together)
        for table in (plain, plain.union(odd)):
            for k in (4, 20):
                same(kmers.shared_kmers(table, k), kmers._joined_shared(table.withColumn("seq", F.replace("seq", F.lit("-"), F.lit(""))), k, 0))
    monkeypatch.setattr(matching, "SHARE", 1 << 22)
    plan = kmers.shared_kmers(plain, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 3  # the table's own, letters once, and counts of rows


@pytest.mark.parametrize("share, together, given", [(1 << 22, 1 << 20, 1 << 17), (1 << 22, 50, 7), (600, 50, 7)])
def test_longest_matches_inside_references(spark, monkeypatch, share, together, given):
    """Repeats, equal ends, odd letters, no reference, a reference too large for a task; against hits of k-mers and walks by joins."""
    import random

    from strandline.operators import kmers, longest, matching

    pick = random.Random(5)
    text = lambda n, of="ACGT": "".join(pick.choices(of, k=n))
    base, line = text(500), text(40)
    reference = spark.createDataFrame([(1, base), (2, text(90, "AC")), (3, "acgé" * 9), (4, ""), (5, "A" * 40), (7, line * 4), (None, base)], "ref_idx long, seq string")
    queries = [(1, 1, base[90:400] + text(50)), (1, 2, base[-30:]), (2, 1, text(120, "AC")), (3, 1, "gécacgég" * 5), (4, 1, base), (5, 2, "A" * 50), (6, 1, base), (7, 1, text(9) + line * 2 + line[5:]), (7, 2, None), (7, 3, "A"), (None, 1, base)]
    queries = spark.createDataFrame(queries, "ref_idx long, query_idx long, seq string").repartition(3)
    monkeypatch.setattr(matching, "SHARE", share)
    monkeypatch.setattr(longest, "TOGETHER", together)
    monkeypatch.setattr(longest, "GIVEN", given)
    known = queries.where("ref_idx is not null")  # a null is no reference, as in SQL
    for least in (3, 15, 25):
        wanted = kmers._matches_by_hits(known, reference, least)
        same(kmers.longest_matches(queries, reference, least), wanted)
        listed = wanted.groupBy("ref_idx", "query_idx", "query_pos", "length").agg(F.array_sort(F.collect_list("ref_pos")).alias("ref_positions"))
        same(kmers.prefix_matches(queries, reference, least), listed)
    for unique in (False, True):
        wanted = kmers._seeds_by_hits(known, reference, 5, unique)
        same(kmers.greedy_seeds(queries, reference, 5, unique), wanted)
        same(kmers.greedy_seeds(kmers._with_reference(queries, reference), None, 5, unique), wanted)


def test_seeds_take_one_exchange(spark):
    """A repeat of 3,000 letters against itself: neither hits nor pointers are rows, and no seed is stored."""
    from strandline.operators import kmers

    rows = spark.createDataFrame([(1, None, True, "A" * 3000), (1, 1, False, "A" * 3000)], "ref_idx long, query_idx long, own boolean, seq string")
    seeds = kmers.greedy_seeds(rows, None, 9, unique=True)
    plan = seeds._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "FileScan" not in plan
    assert [tuple(r) for r in seeds.collect()] == [(1, 1, 0, 0, 3000)]


def test_blocks_of_alignments_are_extended_as_they_pass(spark):
    """Some alignments without blocks, one without a centre; against the blocks of each alignment by themselves."""
    from strandline.operators import extension

    texts = {a: ["ACGTA" * 90, "ACGTA" * 90, "ACG-A" * 90][: 1 + a % 3] for a in range(9)}
    table = spark.createDataFrame([(a, i + (a == 8), s) for a, rows in texts.items() for i, s in enumerate(rows)], "aln_id long, row_idx long, seq string").repartition(3)
    blocks = [(a, w, 1, "0" if a % 3 == 0 else "0,1", 9000.0, 9500.0) for a in range(9) for w in (3, 1) if a % 4]
    merged = spark.createDataFrame(blocks, "aln_id long, first_win long, n_win long, rows string, score double, score_100 double")
    found = extension.extend_blocks(table, merged)
    assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()  # no group an alignment
    wanted = []
    for a in range(8):
        own = [extension.Block(w * 100, w * 100 + 100, tuple(map(int, r.split(","))), s, t) for b, w, _, r, s, t in sorted(blocks) if b == a]
        wanted += [(a, int(b.start), int(b.end), ",".join(map(str, b.rows)), b.score, b.score_100) for b in extension.extend_all(extension.Sheet(dict(enumerate(texts[a]))), own)]
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and wanted


def test_occurrences_are_counted_with_one_exchange(spark, monkeypatch):
    """Sequences over several chunks and over several cuts of letters, letters that are no ASCII, none at all; against running counts."""
    from strandline.operators import composition

    texts = {1: "ACGTN-" * 700, 2: "ACGé-N" * 400, 3: "", 4: None, 5: "N", 6: "-" * 1000, 7: "AC" * 500 + "G"}
    table = spark.createDataFrame([("x", k, s) for k, s in texts.items()], "g string, seq_idx long, seq string").repartition(3)
    wanted = []
    for k, s in texts.items():
        so_far = dict.fromkeys("ACGTN-", 0)
        for i, c in enumerate(s or ""):
            if c in so_far:
                so_far[c] += 1
            wanted.append(("x", k, i, c, *so_far.values()))
    for given in (composition.GIVEN, 2000):
        monkeypatch.setattr(composition, "GIVEN", given)
        found = composition.occurrence_table(table, "g", "seq_idx")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not {w for w in ("Join", "Sort", "Window", "Aggregate") if w in plan} and plan.count("RepartitionByExpression") == 1
        assert found.columns == ["g", "seq_idx", "pos", "base", *(f"n_{k}" for k in composition.SYMBOLS)]
        assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_run_records_meet_in_few_rows(spark, monkeypatch):
    """Records cut by blocks and rows at any line, without runs, with blank lines, behind text without a header; against a plain parser."""
    import random

    from strandline.operators import runs
    from strandline.sources import formats

    pick = random.Random(11)
    texts = {"a": ["lost", "> r1", "3 40"] + [f"{i * 2} {i} " for i in range(9)] + ["", "> r2", "0 7", "> r3 more", "1 5", "", "4 2"], "b": ["> r1", "0 0"], "c": ["lost"], "d": ["> x", "1 9", "2 3", "> y", "2 8", "0 1", "5 5"]}
    wanted = []
    for file, body in texts.items():
        heads = [i for i, line in enumerate(body) if line.startswith(">")]
        for n, (i, j) in enumerate(zip(heads, [*heads[1:], len(body)])):
            own = [tuple(map(int, line.split()[:2])) for line in body[i + 2 : j] if line.strip()] or [(None, None)]
            wanted += [(file, n, body[i][1:].strip(), int(body[i + 1].split()[1]), *r) for r in own]
    for together in (1000, 1, 2, 3):
        monkeypatch.setattr(formats, "TOGETHER", together)
        rows = []
        for file, body in texts.items():
            block = 0
            for i, line in enumerate(body):
                block = i if pick.random() < 0.3 else block
                rows.append((file, block, i, line))
        lines = spark.createDataFrame(pick.sample(rows, len(rows)), "file string, block long, at long, line string").repartition(3)
        found = formats.parse_runs(lines)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # of pieces and blocks' totals
        assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    table = spark.createDataFrame([(1, 0, "NNACN"), (1, 1, ""), (1, 2, None), (2, 0, "AC")], "aln_id long, row_idx long, seq string")
    listed = runs.with_runs(table)
    assert "Exchange" not in listed._jdf.queryExecution().executedPlan().toString()  # no run is grouped
    assert {(r.aln_id, r.row_idx): [tuple(x) for x in r.n_runs] for r in listed.collect()} == {(1, 0): [(0, 2), (2, 1)], (1, 1): [], (1, 2): [], (2, 0): []}


def test_rows_find_the_first_record_of_their_name(spark):
    """Records of one name and of rows that are not there, which widen nothing."""
    from strandline.operators import runs

    aligned = spark.createDataFrame([(1, "b", "ACCGT"), (1, "a", "AC-GT"), (2, "a", "AC")], "aln_id long, name string, seq string")
    records = [(1, 0, "a", 4, 2, 3), (1, 1, "b", 5, None, None), (1, 2, "a", 9, 0, 50), (1, 3, "c", 2, 1, 70), (2, 4, "a", 2, 2, 1), (2, 4, "a", 2, 0, 2)]
    found = runs.restore_named(aligned, spark.createDataFrame(records, "aln_id long, seq_idx long, name string, length long, idx long, number long").repartition(2))
    got = {(r["aln_id"], r["row_idx"]): (r["name"], r["seq"]) for r in found.collect()}
    assert got == {(1, 1): ("b", "ACC--GT"), (1, 0): ("a", "ACNNNGT"), (2, 4): ("a", "NNACN")}


def test_rows_keep_the_number_of_their_record(spark):
    """Records as lists of runs, in several rows, against one row a run; restored letters meet no table of records, and lines without a file are none's."""
    from strandline.operators import runs
    from strandline.sources import formats

    aligned = spark.createDataFrame([(1, "b", "ACCGT"), (1, "a", "AC-GT"), (2, "a", "é-C"), (2, "b", "---"), (2, "c", None)], "aln_id long, name string, seq string")
    records = [(1, 0, "a", 4, 2, 3), (1, 1, "b", 5, None, None), (1, 2, "a", 9, 0, 50), (2, 4, "a", 2, 2, 1), (2, 4, "a", 2, 0, 2), (2, 5, "b", 0, 0, 3)]
    single = spark.createDataFrame(records, "aln_id long, seq_idx long, name string, length long, idx long, number long").repartition(2)
    listed = single.groupBy("aln_id", "seq_idx", "name", "length", (F.col("idx") > 1).alias("late")).agg(F.expr("filter(collect_list(struct(idx, number)), r -> r.idx is not null)").alias("runs")).drop("late")
    found = runs.restore_named(aligned, listed)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    same(found, runs.restore_named(aligned, single))
    lines = spark.createDataFrame([(None, 0, 0, "> x"), (None, 0, 1, "0 1"), *(("f", b, i, t) for b in range(2) for i, t in enumerate(["> r", "2 9", "1 4", "2 2"]))], "file string, block long, at int, line string").coalesce(1)
    listed = formats.parse_listed_runs(lines)
    assert "array_sort" not in listed._jdf.queryExecution().executedPlan().toString()  # lines are put together before they are exchanged
    assert [(r["seq_idx"], r["name"], r["length"], [tuple(x) for x in r["runs"]]) for r in listed.orderBy("seq_idx").collect()] == [(i, "r", 9, [(1, 4), (2, 2)]) for i in range(2)]
    assert {(r["aln_id"], r["row_idx"], r["name"]): r["seq"] for r in found.collect()} == {(1, 0, "a"): "ACNNNGT", (1, 1, "b"): "ACC--GT", (2, 4, "a"): "NNé-CN", (2, 5, "b"): "--NNN-"}
