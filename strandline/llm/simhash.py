"""SimHash near duplicates by bit-sliced comparison.

A text's words (lower-cased A-Z) give shingles of ``k`` words, repeats included; a bit of
its 64-bit fingerprint is set where more than half of the shingles' XXH64 have it.  Equal
fingerprints are one class.  Two classes link where their fingerprints differ in at most
``radius`` bits; links connect documents into components.

Fingerprints are compared in buckets.  The bits are cut into ``radius + 1`` pieces, so two
fingerprints that link agree in a whole piece: each fingerprint is put into one bucket a
piece, named by the mask of the bits it fixes and their values.  A bucket with more than
``most`` fingerprints is cut again by the bits that are still free, ``levels`` times at
most; what stays large after that is compared in pairs of blocks, dealt to tasks.

Inside a bucket the block is stored vertically: a plane for each bit, with one bit a
fingerprint.  Distances of many pairs are counted at once: planes are compared as whole
words and added by carry-save adders into counters of ones, twos and fours; after each
eight planes, words in which all distances exceed the radius are abandoned.  Of a block's
links those that only close a cycle are left out, as they change no component.

Null and empty texts, and texts without words, have the fingerprint zero, which links like
any other; a text with fewer words than ``k`` has its whole sequence as its one shingle.
Whole texts are read, in windows of about 1 MB.  Repeated rows are rows of their own with
equal results; a component is named by its smallest key, and by null only where it has no
other.  An empty table gives an empty result.  Further columns are not read, so their names
clash with none here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import lean, slices, stored

SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONES = ~np.uint64(0)


# ---- fingerprints


def _shingle_hashes(text: bytes, k: int, window: int = 1 << 20) -> Iterator[list[int]]:
    """XXH64 of all shingles of a text, a list for each window of it."""
    low = text.translate(_LOWER)
    held: list[bytes] = []
    at, some = 0, False
    while at < len(low):
        end = low.find(b" ", at + window)
        end = end if end >= 0 else len(low)
        held += low[at:end].split()
        if len(held) >= k:
            joined = b" ".join(held)
            ends = np.cumsum([len(w) + 1 for w in held])
            starts = np.concatenate([[0], ends[: len(held) - k]]).tolist()
            yield [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]
            held, some = held[len(held) - k + 1 :], True
        at = end
    if held and not some:
        yield [xxhash.xxh64_intdigest(b" ".join(held), SEED)]


def fingerprint(text: bytes, k: int = 4, window: int = 1 << 20) -> int:
    """The SimHash of a text; bit i of the number is bit i of the hashes."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in _shingle_hashes(text, k, window):
        values = np.array(hashes, dtype=np.uint64)
        n += len(values)
        for part in np.split(values, range(1 << 14, len(values), 1 << 14)):
            counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """key, fp (the fingerprint as a signed 64-bit number) of every row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([fingerprint(t or b"", k) for t in part.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found.view(np.int64))], names=["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"key {kind}, fp long")


# ---- bit-sliced comparison


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 planes of whole words: bit f of plane b is bit b of value f; the last word is filled up with zeros."""
    words = -(-len(values) // 64)
    bits = np.zeros((64, words * 64), dtype=np.uint8)
    bits[:, : len(values)] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: (sum, carry) of three words of bits."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def close_pairs(queries: np.ndarray, values: np.ndarray, radius: int, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (of queries, of values) of all pairs that differ in at most ``radius`` (less than 8) bits.

    Every query is compared with whole words of 64 values; ``chunk`` bounds the words that are counted at once.
    """
    planes = bit_planes(values)
    words = planes.shape[1]
    filled = np.full(words, _ONES)
    if len(values) % 64:
        filled[-1] = (np.uint64(1) << np.uint64(len(values) % 64)) - np.uint64(1)
    step = max(1, chunk // max(words, 1))
    for begin in range(0, len(queries), step):
        own = queries[begin : begin + step]
        row, word = np.divmod(np.arange(len(own) * words), words)
        ones = twos = fours = np.zeros(len(row), np.uint64)
        over = ~filled[word]
        for group in range(0, 64, 8):
            flip = np.where((own[:, None] >> np.arange(group, group + 8, dtype=np.uint64)) & np.uint64(1), _ONES, np.uint64(0))
            d = [planes[group + b][word] ^ flip[row, b] for b in range(8)]
            ones, a = _add(ones, d[0], d[1])
            ones, b = _add(ones, d[2], d[3])
            twos, c = _add(twos, a, b)
            ones, a = _add(ones, d[4], d[5])
            ones, b = _add(ones, d[6], d[7])
            twos, e = _add(twos, a, b)
            fours, eights = _add(fours, c, e)
            over = over | eights | _exceeds(ones, twos, fours, radius)
            live = np.flatnonzero(over != _ONES)
            if len(live) < len(row):  # words in which every distance exceeds the radius are abandoned
                if not len(live):
                    break
                row, word, ones, twos, fours, over = (x[live] for x in (row, word, ones, twos, fours, over))
        else:
            near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(near)
            yield begin + row[at], word[at] * 64 + bit


def _exceeds(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Where the count 4 * fours + 2 * twos + ones is above ``radius``: from the highest bit, equal so far and then greater."""
    above, equal = np.zeros_like(ones), np.full_like(ones, _ONES)
    for counter, bit in ((fours, radius & 4), (twos, radius & 2), (ones, radius & 1)):
        if bit:
            equal = equal & counter
        else:
            above, equal = above | (equal & counter), equal & ~counter
    return above


def spanning_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside ``left``, or between it and ``right``, without those that only close a cycle."""
    values = left if right is None else right
    shift = 0 if right is None else len(left)
    parent = np.arange(len(left) + (0 if right is None else len(right)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for q, v in close_pairs(left, values, radius):
        if right is None:
            q, v = q[q < v], v[q < v]
        for i, j in zip(q.tolist(), v.tolist()):
            a, b = root(i), root(j + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    i, j = np.array(out, dtype=np.int64).reshape(-1, 2).T
    return left[i], values[j]


# ---- buckets


def cut_bits(mask: int, pieces: int) -> list[int]:
    """The bits outside ``mask``, in ``pieces`` masks of nearly one size."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [len(free) * i // pieces for i in range(pieces + 1)]
    return [sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(rows: DataFrame, masks: list[int], pieces: int) -> tuple[DataFrame, list[int]]:
    """Rows (mask, fp) once for each piece of the bits that their mask leaves free, and the masks that they then have."""
    finer = {m: [m | piece for piece in cut_bits(m, pieces)] for m in masks}
    table = F.create_map(*(x for m, more in finer.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*(F.lit(_signed(f)).cast("long") for f in more)))))
    return rows.select(F.explode(F.element_at(table, F.col("mask"))).alias("mask"), "fp"), sorted({f for more in finer.values() for f in more})


def _key() -> list[Column]:
    return [F.col("mask"), F.col("mask").bitwiseAND(F.col("fp")).alias("value")]


def buckets(fps: DataFrame, radius: int, most: int, levels: int) -> tuple[DataFrame, DataFrame | None]:
    """(mask, value, fp of buckets with ``most`` fingerprints or fewer; the same with n for what stays larger, or None)."""
    rows, masks, small = fps.select(F.lit(0).cast("long").alias("mask"), "fp"), [0], None
    for _ in range(levels):
        rows, masks = _cut(rows, masks, radius + 1)
        rows = stored(rows.select(*_key(), "fp"), "buckets")
        large = stored(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > most), "large-buckets")
        # large buckets are few: each has more than `most` rows of radius + 1 times as many as there are fingerprints
        done = rows.join(large, ["mask", "value"], "left_anti")
        small = done if small is None else small.unionByName(done)
        if large.isEmpty():
            return small, None
        rows = rows.join(large, ["mask", "value"])
    return small, rows


def _blocks(large: DataFrame, most: int) -> DataFrame:
    """Fingerprints of large buckets once for each pair of blocks of their bucket: mask, value, p, q, side, fp."""
    dealt = large.withColumn("blocks", F.ceil(F.col("n") / most).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("mask", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")


def _compare(radius: int):
    """Links (u, v) of rows that come sorted by bucket and pair of blocks; holds one bucket, or one pair of blocks, at a time."""

    def links(fps: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = fps[sides == 0], fps[sides == 1]
        return spanning_links(left.view(np.uint64), right.view(np.uint64) if len(right) else None, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns mask, value, p, q, side, fp
        names = ["mask", "value", "p", "q", "side", "fp"]

        def close(rows: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.any(rows[:4, 1:] != rows[:4, :-1], axis=0)) + 1
            out = [links(part[5], part[4]) for part in np.split(rows, edges, axis=1) if part.shape[1] > 1]
            u, v = (np.concatenate([x[i] for x in out]).view(np.int64) if out else np.zeros(0, np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
            if not rows.shape[1]:
                continue
            held.append(rows)
            changes = np.flatnonzero(np.any(rows[:4] != rows[:4, -1:], axis=0))
            begun = np.any(held[0][:4, 0] != rows[:4, -1])
            if begun:  # all but the last bucket is complete
                every = np.concatenate(held, axis=1)
                cut = every.shape[1] - rows.shape[1] + (int(changes[-1]) + 1 if len(changes) else 0)
                yield close(every[:, :cut])
                held = [every[:, cut:]]
        if held:
            yield close(np.concatenate(held, axis=1))

    return run


def links(fps: DataFrame, radius: int = 4, most: int = 4096, levels: int = 3) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` that connect every two within ``radius`` of each other, directly or through others."""
    small, large = buckets(fps, radius, most, levels)
    none = F.lit(0).cast("int")
    rows = small.select("mask", "value", none.alias("p"), none.alias("q"), none.alias("side"), "fp")
    if large is not None:
        rows = rows.unionByName(_blocks(large, most))
    keys = ["mask", "value", "p", "q"]
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(partitions, *keys).sortWithinPartitions(*keys, "side", "fp")
    return dealt.mapInArrow(lean(_compare(radius)), "u long, v long").distinct()


# ---- documents


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4, most: int = 4096, levels: int = 3, hot: int = 512) -> DataFrame:
    """key, fp, component_id (the smallest key that links reach) of every row.

    A fingerprint that has one in ``hot`` of all rows or more gets its component by a
    broadcast, so its rows are not shuffled; there are at most ``hot`` of them.
    """
    rows = stored(fingerprints(df, key, text, k), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(links(classes.select("fp"), radius, most, levels))
    rooted = stored(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "n", "component_id")
    named = stored(named, "named-classes")
    often = F.col("n") * hot >= total
    by_hot = rows.join(F.broadcast(named.where(often).select("fp", F.lit(True).alias("_hot"), F.col("component_id").alias("_named"))), "fp", "left")
    rare = by_hot.where("_hot is null").select("key", "fp").join(named.where(~often).select("fp", "component_id"), "fp")
    every = by_hot.where("_hot").select("key", "fp", F.col("_named").alias("component_id")).unionByName(rare.select("key", "fp", "component_id"))
    return every.withColumnRenamed("key", key)
