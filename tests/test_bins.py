"""Points in intervals by nested bins against all pairs."""

import random

from strandline.operators import segments


def test_nested_bins(spark):
    rng = random.Random(4)
    intervals = [(k, a, a + n) for k in range(3) for a in (0, 1, 7, 63, 64, 1000, 10**9) for n in (0, 1, 2, 3, 10, 64, 65, 10**6)] + [(1, 5, 5), (2, 9, 3)]
    points = [(k, rng.choice([0, 1, 2, 9, 63, 64, 66, 127, 128, 999, 10**6, 10**9 + 5, 5 * 10**9])) for k in range(4) for _ in range(20)]
    found = segments.points_in_intervals(spark.createDataFrame(points, "k long, idx long"), spark.createDataFrame(intervals, "k long, start long, stop long"), ["k"])
    wanted = sorted((k, p, a, b) for k, p in points for j, a, b in intervals if j == k and a <= p < b)
    assert sorted((r["k"], r["idx"], r["start"], r["stop"]) for r in found.collect()) == wanted
    none = segments.points_in_intervals(spark.createDataFrame(points, "k long, idx long"), spark.createDataFrame([], "k long, start long, stop long"), ["k"])
    assert none.count() == 0
