"""The allocator of free places against its promises and a plain version of its rounds."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import simulate
from strandline.operators.allocate import allocate, allocate_few


def number(key, rank, turn):
    return (key * 7919 + rank * 104729 + turn * 1299709 + 17) % 1000003


def free_starts(total, taken, width):
    """Starts at which ``width`` positions are free, in order."""
    used = [False] * total
    for start, n in taken:
        used[start : start + n] = [True] * n
    return [i for i in range(total - width + 1) if not any(used[i : i + width])]


def plain(totals, requests):
    """The rounds of the docstring, one sequence after another, position by position."""
    out = {}
    for key, total in totals.items():
        waiting, settled, turn = {r: w for k, r, w in requests if k == key}, {}, 0
        while waiting:
            claims = {}
            for r, w in waiting.items():
                starts = free_starts(total, settled.values(), w)
                if starts:
                    claims[r] = (starts[number(key, r, turn) % len(starts)], w, len(starts))
            lost = {r for r, (a, w, _) in claims.items() for q, (b, v, _) in claims.items() if q < r and b < a + w and a < b + v}
            ample = all(n > sum(v for _, v, _ in claims.values()) + len(claims) * (w - 1) for _, w, n in claims.values())
            won = {r for r in claims if r not in lost and (ample or not lost or r < min(lost))}
            settled |= {r: claims[r][:2] for r in won}
            waiting = {r: claims[r][1] for r in claims if r not in won}
            turn += 1
        out |= {(key, r): a for r, (a, _) in settled.items()}
    return out


def placed(spark, totals, requests):
    made = spark.createDataFrame(list(totals.items()), "k long, total long")
    asked = spark.createDataFrame(requests, "k long, rank long, width long")
    draw = lambda turn: (F.col("k") * 7919 + F.col("rank") * 104729 + F.lit(turn * 1299709 + 17)) % 1000003
    return {(r["k"], r["rank"]): r["start"] for r in allocate(made, asked, ["k"], draw).collect()}


def test_rounds_and_promises(spark):
    rng = random.Random(1)
    totals = {0: 0, 1: 1, 2: 10, 3: 40, 4: 90, 5: 400, 6: 2000, 7: 30}
    requests = [(k, r, rng.choice([1, 1, 2, 5, 11])) for k in range(7) for r in range(14)] + [(7, 0, 31), (7, 1, 30), (7, 2, 1)]
    found = placed(spark, totals, requests)
    assert found == plain(totals, requests)
    width = {(k, r): w for k, r, w in requests}
    for k, total in totals.items():
        own = sorted((a, a + width[key]) for key, a in found.items() if key[0] == k)
        assert all(x[1] <= y[0] for x, y in zip(own, own[1:])) and all(0 <= a and b <= total for a, b in own)
        for key in (x for x in width if x[0] == k and x not in found):  # nothing that fits beside what goes before it is left out
            assert not free_starts(total, [(a, width[q]) for q, a in found.items() if q[0] == k and q[1] < key[1]], width[key])
    assert (7, 0) not in found and found[7, 1] == 0 and (7, 2) not in found


def test_no_requests(spark):
    assert placed(spark, {1: 5}, [(2, 0, 1)]) == {}


def test_variants_get_all_room_there_is(spark):
    wanted = {simulate.INVERSION: (1, 30), simulate.TRANSLOCATION: (1, 10), simulate.TANDEM: (2, 8), simulate.SMALL_INSERT: (3, 1)}
    ref = simulate.random_sequences(spark.createDataFrame([(i,) for i in range(3)], "seq_idx long"), 120).unionByName(spark.createDataFrame([(7, "ACGT" * 8), (8, ""), (9, "A" * 31)], "seq_idx long, seq string"))
    rows = simulate.allocated_variants(ref, wanted).collect()
    by = lambda k: sorted(r["sv_type"] for r in rows if r["seq_idx"] == k)
    assert all(by(k) == sorted([simulate.INVERSION, simulate.TRANSLOCATION, simulate.TANDEM, simulate.TANDEM, *[simulate.SMALL_INSERT] * 3]) for k in range(3))
    assert by(7) == [simulate.INVERSION] and by(8) == [] and by(9) == [simulate.INVERSION]
    variants = spark.createDataFrame(rows)
    edits = simulate.variant_edits(variants, ref)
    assert {r["seq_idx"]: len(r["seq"]) for r in simulate.apply_edits(ref, edits).collect()} == {0: 139, 1: 139, 2: 139, 7: 32, 8: 0, 9: 31}


@pytest.mark.parametrize("times", [2, 4])
def test_one_truth_block_a_copy_in_order(spark, times):
    ref = simulate.random_sequences(spark.createDataFrame([(3,)], "seq_idx long"), 400)
    variants = simulate.allocated_variants(ref, {simulate.TANDEM: (2, 20), simulate.INVERTED_DUPLICATION: (1, 20), simulate.INVERSION: (1, 20)})
    edits = simulate.variant_edits(variants, ref, times)
    blocks = simulate.truth_blocks(variants, edits, ref).collect()
    shown = {}
    for r in blocks:
        shown.setdefault(r["ord"], {})[r["name"]] = r
    assert sorted(shown) == list(range(2 * (times - 1) + 2))
    places = [(shown[i]["reference"]["start"], shown[i]["sv_id"] if "sv_id" in shown[i] else 0) for i in sorted(shown)]
    assert [p[0] for p in places] == sorted(p[0] for p in places)
    for own in shown.values():
        assert own["simulated"]["seq"] == own["expected"]["seq"] and len(own["expected"]["seq"]) == 20


def test_few_requests_are_settled_in_a_task(spark, monkeypatch):
    """The rounds of a plan of variants are those of the distributed allocator, in one stage that stores nothing."""
    rng = random.Random(2)
    asked = sorted((r, rng.choice([1, 1, 2, 5, 11])) for r in range(14))
    totals = {k: n for k, n in enumerate([0, 1, 10, 40, 90, 400, 2000])}
    made = spark.createDataFrame([*totals.items(), (7, None), (None, 5)], "k long, total long")
    rows = allocate_few(made, asked, lambda key, rank, turn: (key * 7919 + rank * 104729 + turn * 1299709 + 17) % 1000003).collect()  # number, which workers cannot import
    assert [r["starts"] for r in rows if r["k"] == 7] == [[None] * len(asked)] and all(r["k"] is not None for r in rows)
    found = {(row["k"], r): a for row in rows for (r, _), a in zip(asked, row["starts"]) if a is not None}
    assert found == plain(totals, [(k, r, w) for k in totals for r, w in asked])
    wanted = {simulate.INVERSION: (1, 30), simulate.TRANSLOCATION: (2, 10), simulate.SMALL_INSERT: (3, 1)}
    ref = simulate.random_sequences(spark.createDataFrame([(i,) for i in range(3)], "seq_idx long"), 70).unionByName(spark.createDataFrame([(7, "ACGT" * 8), (8, ""), (9, None)], "seq_idx long, seq string"))
    monkeypatch.setattr(simulate, "FEW", 0)
    before = sorted(simulate.allocated_variants(ref, wanted).collect())
    monkeypatch.undo()
    for module in ("allocate", "simulate"):
        monkeypatch.setattr(f"strandline.operators.{module}.stored", lambda *_: pytest.fail("a round is stored"))
    assert sorted(simulate.allocated_variants(ref, wanted).collect()) == before
