"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; ASCII A-Z count as
a-z, other bytes are compared as they are.  A whole batch is hashed with a few numpy
passes over its byte buffer: a polynomial prefix sum modulo 2**64 gives every word's
hash as a difference of two prefix values, so no Python object is made per word.

Null texts count as empty.  64-bit hashes stand for words and shingles; two different
ones agree with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += _U(32)
    return mix(lower + _U(0x1000))


_VALUE = _byte_values()
_INVERSE = pow(_MULT, -1, 2**64)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Powers are products of a low and a high table, so that tables stay small however long a text is.
_BLOCK = 1 << 16


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_UP_LOW, _UP_HIGH = _power_table(_MULT, _BLOCK), _power_table(pow(_MULT, _BLOCK, 2**64), 1 << 15)
_DOWN_LOW, _DOWN_HIGH = _power_table(_INVERSE, _BLOCK), _power_table(pow(_INVERSE, _BLOCK, 2**64), 1 << 15)


class _Sums:
    """Prefix sums of a batch's byte values times powers of their places; one array of the batch's length."""

    def __init__(self, raw: np.ndarray, values: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(raw), _BLOCK):
                part = self.sums[i + 1 : i + 1 + _BLOCK]
                np.multiply(values[raw[i : i + _BLOCK]], _UP_LOW[: len(part)], out=part)
                part *= _UP_HIGH[i // _BLOCK]
            np.cumsum(self.sums, out=self.sums)

    def between(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The polynomial of each range, from its own start."""
        with np.errstate(over="ignore"):
            return (self.sums[stops] - self.sums[starts]) * (_DOWN_LOW[starts % _BLOCK] * _DOWN_HIGH[starts // _BLOCK])


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(column) else raw[:0], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word starts, first word of each text and the total) of a batch."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SEP[raw]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offsets[1:] - 1
    after[ends[ends >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    with np.errstate(over="ignore"):
        hashes = mix(_Sums(raw, _VALUE).between(starts, stops))
    return hashes, starts, np.searchsorted(starts, offsets)


def word_prefixes(raw: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of all words, and of their first bytes where they are longer than one of ``lengths``."""
    hashes, starts, first = words(raw, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(hashes):
        return hashes, text
    ends = np.flatnonzero(np.append(_SEP[raw], True))
    stops = np.minimum(ends[np.searchsorted(ends, starts)], offsets[1:][text])
    out, of = [hashes], [text]
    sums = _Sums(raw, _VALUE)
    with np.errstate(over="ignore"):
        for n in lengths:
            longer = np.flatnonzero(stops - starts > n)
            at = starts[longer]
            out.append(mix(sums.between(at, at + n) + _U(n)))
            of.append(text[longer])
    return np.concatenate(out), np.concatenate(of)


_RAW_VALUE = mix(np.arange(256, dtype=np.uint64) + _U(0x2000))


def range_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, letter case included."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix(_Sums(raw, _RAW_VALUE).between(starts, stops))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each text and the total).

    A text with fewer than ``k`` words, but at least one, has its whole sequence as its
    only shingle; a text without words has none.
    """
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        if len(hashes) >= k:
            rolled = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
            for i in range(k):
                rolled = rolled * _U(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - k + 1 + i]
            rolled = mix(rolled + _U(k))
        else:
            rolled = np.zeros(0, dtype=np.uint64)
        per_text = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
        out_first = np.concatenate([[0], np.cumsum(per_text)])
        where = np.repeat(first[:-1] - out_first[:-1], per_text) + np.arange(out_first[-1])
        out = np.empty(out_first[-1], dtype=np.uint64)
        whole = np.repeat(counts >= k, per_text)
        out[whole] = rolled[where[whole]]
        for t in np.flatnonzero((counts > 0) & (counts < k)):
            value = _U(counts[t])
            for h in hashes[first[t] : first[t + 1]]:
                value = value * _U(0xD6E8FEB86659FD93) + h
            out[out_first[t]] = mix(np.array([value + _U(0x5EED)], dtype=np.uint64))[0]
    return out, out_first


def shingle_sets(column: pa.Array | pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of every text."""
    raw, offsets = text_buffer(column)
    hashes, _, first = words(raw, offsets)
    out, at = shingles(hashes, first, k)
    return [np.unique(out[a:b]) for a, b in zip(at[:-1], at[1:])]
