"""Importance resampling against a plain version, and its odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(documents, target, percent=5, least=20):
    s, t = Counter(b for _, text in documents for b in grams(text)[1]), Counter(b for text in target for b in grams(text)[1])
    total_s, total_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = {b: math.floor(1000.0 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in s}
    rows = []
    for key, text in documents:
        n, own = grams(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append((key, n, len(own), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = Counter({i: n for n, i in enumerate(able[: len(able) * percent // 100], 1)}) if len(set(able)) == len(able) else None
    return rows, ranks, [r[:5] for r in able[: len(able) * percent // 100]]


def test_agrees_with_a_plain_version_on_given_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    documents = [tuple(r) for r in rows]
    wanted, ranks, _ = plain(documents, [r["text"] for r in target.collect()])
    found = importance.resample(spark.createDataFrame(rows), target).collect()
    assert Counter(tuple(r) for r in found) == Counter((*r, ranks.get(r)) for r in wanted)
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(ranks) + 1)) and ranks


@pytest.mark.parametrize("words", [1, 2, 3, 511, 512, 513, 514, 515, 1023, 1024, 1025, 1026, 1027, 3000])
def test_chunk_edges_lose_and_repeat_nothing(spark, words):
    text = " ".join(f"w{i}" for i in range(words))
    positions = importance.position_table(spark.createDataFrame([(1, text)], "key long, text string"))
    found = Counter(r["bucket"] for r in positions.select(F.explode(F.array("b1", "b2", "b3")).alias("bucket")).where("bucket is not null").collect())
    assert found == Counter(grams(text)[1])


def test_windows_of_long_texts_cut_no_word():
    text = b" ".join(b"word%d" % i for i in range(5000))
    chunks = list(importance._chunks(text, 3, window=100))
    assert b" ".join(b" ".join(c.split()[: importance.CHUNK]) for c in chunks) == text and len(chunks) == 10


def test_odd_rows(spark):
    documents = [(1, None), (2, ""), (3, "  --  \t"), (4, "ÄÖ É x9 Ünï x9"), (5, "Same words here " * 10), (5, "Same words here " * 10), (None, "no key " * 15), (6, "a" * 70_000), (7, "z y " * 3000)]
    df = spark.createDataFrame(documents, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "key", "chunk", "b1", "weight", "rank")})
    target = [None, "", "z y x9"]
    wanted, _, best = plain(documents, target, percent=60)
    found = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=60).collect()
    assert Counter(r[:5] for r in map(tuple, found)) == Counter(wanted)
    drawn = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == [1, 2] and [tuple(r)[:5] for r in drawn] == best


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    wanted, _, _ = plain([(1, "a b c " * 10), (2, None)], [])
    assert Counter(tuple(r)[:5] for r in importance.resample(some, none).collect()) == Counter(wanted)
