"""SimHash near duplicates against plain versions, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import simhash
from strandline.llm.queries import op11_bit_sliced

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    """Label of each fingerprint: the least position that links reach."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= radius and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def plain(documents):
    fps = [plain_fingerprint(t) for _, t in documents]
    labels = plain_components(fps)
    least = {}
    for (key, _), label in zip(documents, labels):
        if key is not None:
            least[label] = min(key, least.get(label, key))
    return Counter((key, f"{fp:016x}", least.get(label)) for (key, _), fp, label in zip(documents, fps, labels))


def written(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "fp", "component_id", "n", "mask")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def near(base, rng, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << b
    return base


def clustered(n, seed, most):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 20))]
    return list(dict.fromkeys(near(rng.choice(centres), rng, most) for _ in range(n)))


def test_given_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, op11_bit_sliced(spark, "/root/testdata/sf0.001").collect())) == plain(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(5, None), (4, ""), (9, " \t\n\x0b\x0c\r "), (3, "One TWO three"), (2, "one two THREE"), (8, "one two three four"), (7, "Ä b ä c É d"), (6, "x " * 3000), (6, "x " * 3000), (None, "x " * 3000), (None, "no key at all here"), (1, "  lone  "), (11, "w" * 70_000)]
    assert Counter(map(tuple, op11_bit_sliced(spark, written(spark, tmp_path, rows)).collect())) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert op11_bit_sliced(spark, written(spark, tmp_path, [])).count() == 0


def test_windows_of_long_texts_lose_no_shingle():
    text = " ".join(f"Word{i % 37} x{i}" for i in range(3000)) + "\n tail"
    assert simhash.fingerprint(text.encode(), window=50) == simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", range(8))
def test_close_pairs(radius):
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    queries, values = ([near(base, rng, 9) for _ in range(n)] for n in (70, 131))
    found = {(int(i), int(j)) for a, b in simhash.close_pairs(np.array(queries, np.uint64), np.array(values, np.uint64), radius, chunk=64) for i, j in zip(a, b)}
    assert found == {(i, j) for i, x in enumerate(queries) for j, y in enumerate(values) if (x ^ y).bit_count() <= radius}


@pytest.mark.parametrize(("most", "levels"), [(4096, 3), (8, 1), (8, 2), (16, 3)])
def test_links_connect_what_brute_force_connects(spark, most, levels):
    fps = clustered(400, most * levels, 5) + [near((1 << 64) - 1, random.Random(i), 3) for i in range(60)]
    fps = list(dict.fromkeys(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 4, most, levels).collect()
    place = {s[0]: i for i, s in enumerate(signed)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in found:
        assert (fps[place[u]] ^ fps[place[v]]).bit_count() <= 4
        a, b = sorted((root(place[u]), root(place[v])))
        parent[b] = a
    assert [root(i) for i in range(len(fps))] == plain_components(fps)


def test_hot_fingerprints_and_spread_ones_agree(spark):
    rows = [(i, "the same four words" if i % 3 else f"other text number {i} here") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = lambda hot: Counter(map(tuple, simhash.near_duplicates(df, hot=hot).collect()))
    assert by(2) == by(512) == by(1)


def test_cut_bits_parts_the_free_bits():
    for mask in (0, 0xFFFF, (1 << 64) - 1 - 0b1011):
        parts = simhash.cut_bits(mask, 5)
        assert sum(parts) == (1 << 64) - 1 - mask and all(p & q == 0 for i, p in enumerate(parts) for q in parts[:i])
