"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a document with at most ``k`` character edits, ``k`` being a share
of its length.  Cut into ``k + 1`` pieces, at least one piece then occurs unchanged, so
an Aho-Corasick automaton over all pieces finds every candidate place; Myers'
bit-parallel algorithm measures the distance there.  Texts are compared in lower case
with every run of other characters than letters and digits as one space.

Items are taken in blocks of bounded size (``block_bytes``), each block being one pass
over the documents; nothing that is sent to executors grows with the documents.
Items without letters or digits match nothing; an item of one or two letters has a budget of
no edits and hits every text that holds it, in a word too; null and empty texts have no hits;
repeated items are reported under each id, repeated rows once each.  Whole texts are
searched, in slices of about 1 MB, a longer text alone.  Of equally near places the first
is reported.  Empty tables have no hits.  ``find_leaks`` returns its own columns only,
``decontaminate`` keeps all of the table's, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import lean, slices, stored

_OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of near equal length with their places."""
    n = min(k + 1, len(item))
    ends = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``pattern`` in ``text`` within ``k`` edits; ties go to the first end."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    vp, vn, score, best = full, 0, len(pattern), None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp) & full
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        vp = (hn << 1 & full) | ~(d0 | hp) & full
        vn = hp & d0
        if score <= k and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """Finds all items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, s, budget(s, rate)) for i, t in items if (s := normalised(t))]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item, k) in enumerate(self.items):
            for offset, piece in pieces(item, k):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of the best occurrence of each item."""
        if not self.items or not text:
            return []
        body = normalised(text)
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(body):
            for n, offset in places:
                starts.setdefault(n, set()).add(end + 1 - length - offset)
        found = []
        for n, begins in starts.items():
            ident, item, k = self.items[n]
            best, spans = None, []
            for s in sorted(begins):  # overlapping windows are searched as one
                a, b = max(0, s - k), s + len(item) + k
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans:
                hit = myers(item, body[a:b], k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
            if best:
                found.append((ident, *best))
        return found


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_bytes`` characters, streamed through the driver."""
    block, size = [], 0
    for row in benchmark.where(F.col(text).isNotNull()).select(item_id, text).toLocalIterator():
        if block and size + len(row[1]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def find_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.08, block_bytes: int = 8 << 20) -> DataFrame:
    """(key, item_id, distance, end) for every item within its error budget in a text."""
    kinds, names = dict(df.dtypes), dict(benchmark.dtypes)
    schema = f"`{key}` {kinds[key]}, `{item_id}` {names[item_id]}, distance int, end_at int"
    out = None
    for block in blocks(benchmark, item_id, item_text, block_bytes):
        held = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, rate)
            for batch in batches:
                for part in slices(batch, "text"):
                    at, hits = [], []
                    for i, value in enumerate(part.column("text").to_pylist()):
                        for hit in matcher.find(value):
                            at.append(i)
                            hits.append(hit)
                    if at:
                        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(at)), pa.array([h[0] for h in hits]), pa.array([h[1] for h in hits], pa.int32()), pa.array([h[2] for h in hits], pa.int32())], names=[key, item_id, "distance", "end_at"])

        part = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _leaking(df: DataFrame, text: str, held, rate: float) -> DataFrame:
    """(digest) of the texts that hold an item of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value, rate)
        for batch in batches:
            for part in slices(batch, "text"):
                hits = [hashlib.sha256(value.encode()).digest() for value in part.column("text").to_pylist() if matcher.find(value)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(hits, pa.binary())], names=["digest"])

    return df.select(F.col(text).alias("text")).mapInArrow(lean(run), "digest binary")


def decontaminate(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", rate: float = 0.08, block_bytes: int = 8 << 20, broadcast_rows: int = 250_000) -> DataFrame:
    """``df`` without the documents that hold a benchmark item; all columns stay.

    One block of items is a filter, and no row is shuffled.  Of several blocks each marks the
    digests of texts in tasks of its own, so a task has one automaton; the marks are
    broadcast up to ``broadcast_rows``, and joined by a shuffle beyond.
    """
    rest = blocks(benchmark, "item_id", "text", block_bytes)
    context = df.sparkSession.sparkContext
    held, second = context.broadcast(next(rest)), next(rest, None)
    if second is not None:
        marks = _leaking(df, text, held, rate)
        for block in itertools.chain([second], rest):
            marks = marks.unionByName(_leaking(df, text, context.broadcast(block), rate))
        marks = stored(marks.distinct(), "leaking-texts")
        few = marks.count() <= broadcast_rows
        digest = F.unhex(F.sha2(df[text].cast("binary"), 256))
        return df.join(F.broadcast(marks) if few else marks, digest == marks["digest"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value, rate)
        for batch in batches:
            for part in slices(batch, text):
                keep = [not matcher.find(value) for value in part.column(text).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)
