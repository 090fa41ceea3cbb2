"""Hash tree and best-fit packing against their laws and plain versions."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import packing, sharding
from strandline.llm.packing import Encoder, sweep

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def shards(spark, df, n, grown=None):
    return sharding.assign_shards(df, sharding.topology(n), grown=sharding.topology(grown) if grown else None).collect()


def test_rows_move_only_into_the_new_shard(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    for n in (8, 9, 11):
        rows = shards(spark, df, n, n + 1)
        assert all(r["grown_shard"] in (r["shard"], n) for r in rows)
        assert 0.3 < (n + 1) / 3000 * sum(r["grown_shard"] == n for r in rows) < 3
        counts = Counter(r["shard"] for r in rows)
        assert len(counts) == n and min(counts.values()) > 3000 / n / 2


def test_weight_change_stays_in_its_subtree(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "'' AS text")
    base = sharding.topology(8)
    heavier = [x if x.shard != 5 else sharding.Leaf(x.region, x.rack, x.shard, 3.0) for x in base]
    a = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(df, base).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(df, heavier).collect()}
    region = {x.shard: x.region for x in base}
    moved = [(a[k], b[k]) for k in a if a[k] != b[k]]
    assert moved and all(region[y] == 1 for _, y in moved)
    assert not any(x == 5 for x, _ in moved)


def test_slots_are_gapless_and_odd_rows_count(spark):
    rows = [(i % 7, "same") for i in range(500)] + [(None, None), (None, "ä"), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x").selectExpr("*", "1 AS shard", "2 AS slot")
    got = shards(spark, df, 8, 9)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == 503 and all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = {(r["doc_id"], r["text_crc32"]): r["size"] for r in got}
    assert sizes[(None, 0)] == 1 and sizes[(None, zlib.crc32("ä".encode()))] == 3
    assert shards(spark, df.limit(0), 8) == []


def plain_best_fit(sizes, capacity):
    gaps, n = [], 0
    for size in sorted(sizes.elements(), reverse=True):
        i = bisect.bisect_left(gaps, size)
        if i < len(gaps):
            left = gaps.pop(i) - size
        else:
            n, left = n + 1, capacity - size
        bisect.insort(gaps, left)
    return n


def test_sweep_is_best_fit():
    draw = random.Random(3)
    for capacity in (10, 97, 2048):
        for _ in range(25):
            sizes = Counter(draw.randint(1, capacity) for _ in range(draw.randint(0, 300)))
            places, got = defaultdict(list), Counter()
            for size, rank, n, first, offset in sweep(sizes, capacity):
                assert rank == got[size]
                got[size] += n
                for i in range(n):
                    places[first + i].append((offset, size))
            assert got == sizes and len(places) == plain_best_fit(sizes, capacity)
            for own in places.values():
                at = 0
                for offset, size in sorted(own):
                    assert offset == at
                    at += size
                assert at <= capacity


ODD = ["", None, "a", " x", "  a  b ", "it's  fine\n\n ok now 　 wide ", "<|endoftext|> a <|endoftext|>", "é è à", "a’s — b 12 3\t4 \n", " ", "\x1c a \x1f b", "a\u0085 b", "“q” ‘r’ s", "word " * 700, "x" * 5000, "\0 a\0 b"]


@pytest.mark.parametrize("most", [50, 400_000])
def test_encoder_equals_tokenizer(most):
    encoder = Encoder(JSON, most)
    for texts in (ODD, ODD[::-1], [t for t in ODD if t and "<|" not in t]):
        ids, first = encoder.encode(pa.array(texts))
        for text, a, b in zip(texts, first, first[1:]):
            assert encoder.tokenizer.encode(text or "", add_special_tokens=False).ids == ids[a:b].tolist()


def test_encoder_with_hashes_that_collide(monkeypatch):
    monkeypatch.setattr(packing, "range_hashes", lambda raw, starts, stops: (stops - starts).astype(np.uint64) % np.uint64(3))
    encoder = Encoder(JSON)
    for texts in (["one two six ten", "two", None, "ten one"], ["red sea", "big sky two"]):
        ids, first = encoder.encode(pa.array(texts))
        for text, a, b in zip(texts, first, first[1:]):
            assert encoder.tokenizer.encode(text or "", add_special_tokens=False).ids == ids[a:b].tolist()


def test_packed_documents(spark):
    texts = ODD + [f"some words {i} " * (i * 3) for i in range(60)] + ["tie tie"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS piece")
    got = packing.pack_documents(df, JSON, capacity=256).collect()
    tokenizer = Encoder(JSON).tokenizer
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // 256)
        at = 0
        for p in pieces:
            assert p["start"] == at and (p["piece"] == 0 or p["length"] == 256)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) == plain_best_fit(Counter(r["length"] for r in got), 256)
    assert packing.pack_documents(df.limit(0), JSON).collect() == []


def test_draws_recomputed_outside_spark(spark):
    """Every key's path through the tree, by the same hash in plain Python."""
    xxhash = pytest.importorskip("xxhash")
    import math
    import struct

    def hashed(level, node, key):
        h = xxhash.xxh64_intdigest(level.encode(), seed=42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", node), seed=h)
        return h if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=h)

    def child(nodes, level, key):
        draw = lambda n: -math.log(((hashed(level, n, key) >> 11) + 0.5) / 2.0**53) / nodes[n]
        return min(sorted(nodes), key=draw)

    def shard(leaves, key):
        chosen = leaves
        for level in ("region", "rack", "shard"):
            nodes = defaultdict(float)
            for leaf in chosen:
                nodes[getattr(leaf, level)] += leaf.weight
            node = child(nodes, level, key)
            chosen = [leaf for leaf in chosen if getattr(leaf, level) == node]
        return node

    leaves = [sharding.Leaf(x.region, x.rack, x.shard, 1.0 + x.shard / 4) for x in sharding.topology(10)]
    keys = [*range(300), None, -5, 2**62]
    df = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(df, leaves).collect()}
    assert got == {k: shard(leaves, k) for k in keys}


def test_packing_of_repeated_rows_and_null_keys(spark):
    rows = [(None, "same words here")] * 3 + [(1, "same words here")] * 2 + [(2, None), (2, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS sequence_id", "8 AS first", "7 AS low")
    got = packing.pack_documents(df, JSON, capacity=8).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and sorted(own)[0][0] == 0
    assert len(places) == plain_best_fit(Counter(r["length"] for r in got), 8)


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_runs_are_found_by_bucket(spark, broadcast_rows):
    draw = random.Random(8)
    sizes = [draw.randint(1, 97) for _ in range(1500)]
    df = spark.createDataFrame([(i, 0, s) for i, s in enumerate(sizes)], "doc_id long, piece int, length long")
    got = packing.pack(df, ["doc_id"], 97, 4, broadcast_rows).collect()
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == 1500 and len(places) == plain_best_fit(Counter(sizes), 97)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 97
