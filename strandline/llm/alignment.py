"""Alignment of two tokenizers over the same texts, and how often their ids stand together.

A text with a space before it is encoded by a byte-level BPE (A) and by a piece model (B),
which puts that space itself.  Both give tokens of bytes; where both have an end, the text
is cut into groups.  A link is a token of A and a token of B that end together, so each
group has one.  Inside ``mapInPandas`` the cumulative ends of both are merged with two
pointers.  Spark counts the pairs of ids over the corpus and joins the counts, and the
largest count of each id of either side, back to every text's links.

A text is cut into segments where a space follows a visible character, which no token of
either side spans (checked on B's pieces when they are loaded; A's pre-tokenizer rules it
out).  A task takes windows of texts and encodes and merges each distinct segment of a
window once: all segments lie one behind the other on one axis of bytes.

Pair counts grow with the corpus and stay distributed.  The ``broadcast_rows`` most
frequent pairs are joined by a broadcast, so no hot pair is shuffled; all others, of which
each has few links, by a shuffle.  Maxima have at most one row for each id of a vocabulary.

Null and empty texts, and texts whose joined bytes differ from the text on either side (a
piece model's space mark inside a text, for instance), have no tokens: zeros and empty
groups.  Texts are read whole.  Each row is a text of its own, also where keys or texts
repeat; ties for the largest count all count as largest.  An empty table gives an empty
result.  Further columns are not read, so their names clash with none here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored

#: A pair of ids is one number: A's id times this, and B's.
SHIFT = 1 << 32


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 as itself, the other bytes in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def merge_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions (in a, in b) at which two rising lists of ends have the same one."""
    out = []
    j, last = 0, len(b)
    for i, end in enumerate(a):
        while j < last and b[j] < end:
            j += 1
        if j == last:
            break
        if b[j] == end:
            out.append((i, j))
    return out


#: A space behind anything but a visible character.
_UNSAFE = re.compile(r"[^!-~\w] |^ ")


class Texts(NamedTuple):
    """Alignments of texts: for each its tokens of A and B, its groups as text, its pairs and how often it has each."""

    n_a: list[int]
    n_b: list[int]
    groups: list[str]
    pairs: list[np.ndarray]
    times: list[np.ndarray]


class Aligner:
    """Both tokenizers, the bytes of their tokens, and their ids as text with what stands behind them."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, table))) for table in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)
        self.written = [f"{i}{mark}" for mark in ",|" for i in range(len(self.bytes_a))] + [f"{i}{mark}" for mark in ",;\n" for i in range(len(self.bytes_b))]

    def segments(self, text: str) -> list[str]:
        """The text cut before each space behind a visible character; the space before each segment, also the first, is left out."""
        if not self.splits:
            return [text]
        parts = text.split(" ")
        if not _UNSAFE.search(text):
            return parts
        out: list[str] = []
        safe = False
        for part in parts:
            if safe or not out:
                out.append(part)
            else:
                out[-1] += " " + part
            last = part[-1:]
            safe = last.isalnum() or "!" <= last <= "~"
        return out

    def _encoded(self, segments: list[str], slice_: int = 1 << 13) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: (ids of all segments, ids of each).  Tokenizers' own objects are held for a slice of segments only."""
        parts: tuple[list, list] = [], []
        for at in range(0, len(segments), slice_):
            own = segments[at : at + slice_]
            a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in own], add_special_tokens=False)]
            b = [ids if s else [self.space] for s, ids in zip(own, self.b.encode(own, num_threads=1))]
            for part, x in zip(parts, (a, b)):
                part.append((np.fromiter(chain.from_iterable(x), np.int32), np.fromiter(map(len, x), np.int32, count=len(x))))
        empty = np.zeros(0, np.int64)
        return [tuple(np.concatenate([empty, *(p[k] for p in part)]) for k in (0, 1)) for part in parts]

    def _whole(self, raw: list[bytes], ids: np.ndarray, counts: np.ndarray, table: list[bytes]) -> np.ndarray:
        """Which segments the joined bytes of their tokens give back."""
        parts = [table[i] for i in ids.tolist()]
        ends = np.cumsum(counts)
        if b"".join(parts) == b"".join(raw):
            sizes = np.fromiter(map(len, parts), np.int64, count=len(parts))
            got = np.append(0, np.cumsum(sizes))[np.append(0, ends)]
            if np.array_equal(np.diff(got), [len(r) for r in raw]):
                return np.ones(len(raw), bool)
        return np.array([b"".join(parts[x:y]) == r for x, y, r in zip([0, *ends.tolist()], ends.tolist(), raw)], bool)

    def merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(whole, tokens of A, tokens of B, groups as text, pairs of all, pairs of each) of segments; the last five only of whole ones."""
        (ids_a, n_a), (ids_b, n_b) = self._encoded(segments)
        raw = [(" " + s).encode("utf-8", "surrogatepass") for s in segments]
        whole = self._whole(raw, ids_a, n_a, self.bytes_a) & self._whole(raw, ids_b, n_b, self.bytes_b)
        ids_a, ids_b = ids_a[np.repeat(whole, n_a)], ids_b[np.repeat(whole, n_b)]
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        i, j = np.array(merge_ends(ends_a.tolist(), ends_b.tolist()), np.int64).reshape(-1, 2).T
        borders = np.cumsum(np.array([len(r) for r in raw], np.int64)[whole])
        own = np.bincount(np.searchsorted(borders, ends_a[i]), minlength=len(borders))
        return whole, n_a[whole], n_b[whole], self._groups(ids_a, ids_b, i, j, np.isin(ends_a[i], borders)), ids_a[i] * SHIFT + ids_b[j], own

    def _groups(self, ids_a: np.ndarray, ids_b: np.ndarray, i: np.ndarray, j: np.ndarray, last: np.ndarray) -> list[str]:
        """Groups as text, one string for each segment; group g ends with token i[g] of A and j[g] of B, and ``last`` ones end a segment."""
        if not len(i):
            return []
        of_a, of_b = np.searchsorted(i, np.arange(len(ids_a))), np.searchsorted(j, np.arange(len(ids_b)))
        code_a, code_b = ids_a.copy(), ids_b + 2 * len(self.bytes_a)
        code_a[i] += len(self.bytes_a)
        code_b[j] += np.where(last, 2, 1) * len(self.bytes_b)
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + np.append(0, j + 1)[of_a]] = code_a
        codes[np.arange(len(ids_b)) + (i + 1)[of_b]] = code_b
        return "".join([self.written[c] for c in codes.tolist()]).split("\n")[:-1]

    def align(self, texts: list[str | None]) -> Texts:
        """The alignments of a window of texts."""
        place: dict[str, int] = {}
        cut = [[place.setdefault(s, len(place)) for s in self.segments(t)] if t else [] for t in texts]
        whole, n_a, n_b, groups, pairs, own = self.merge(list(place))
        at = np.where(whole, np.cumsum(whole) - 1, -1)
        starts = np.cumsum(own) - own
        out = Texts([], [], [], [], [])
        for segments in cut:
            mine = at[np.array(segments, np.int64)]
            if not len(mine) or mine.min() < 0:
                found: tuple = (0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
            else:
                each = own[mine]
                before = np.cumsum(each) - each
                linked = pairs[np.repeat(starts[mine] - before, each) + np.arange(each.sum())]
                found = (int(n_a[mine].sum()), int(n_b[mine].sum()), ";".join([groups[m] for m in mine.tolist()]), *np.unique(linked, return_counts=True))
            for column, value in zip(out, found):
                column.append(value)
        return out


#: Characters of texts that are aligned at once; a longer text alone.
WINDOW = 3 << 20


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2``), pairs (a * 2**32 + b), times of every text."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(path_a, path_b)
        held, size = [], 0

        def aligned() -> pd.DataFrame:
            rows = pd.concat(held)
            found = aligner.align(rows["text"].tolist())
            return pd.DataFrame({"row": rows["row"].to_numpy(), "key": rows["key"].array, "n_a": found.n_a, "n_b": found.n_b, "n_groups": [int(t.sum()) for t in found.times], "groups": found.groups, "pairs": found.pairs, "times": found.times})

        for batch in batches:
            long = batch["text"].str.len().fillna(0).cumsum()
            for _, part in batch.groupby((long // WINDOW).astype("int64"), sort=False):
                held.append(part)
                size += int(part["text"].str.len().fillna(0).sum())
                if size >= WINDOW:
                    yield aligned()
                    held, size = [], 0
        if held:
            yield aligned()

    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    return numbered.mapInPandas(run, f"row long, key {kind}, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>")


def _links(aligned: DataFrame) -> DataFrame:
    return aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", "l.pairs", "l.times").withColumnRenamed("pairs", "pair")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, n (its links in all texts), best_a and best_b (whether no pair of the id of that side has more)."""
    counts = stored(_links(aligned).groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    both = counts.select("pair", F.shiftright("pair", 32).alias("a"), (F.col("pair") % SHIFT).alias("b"), "n")
    most = lambda side: F.broadcast(both.groupBy(side).agg(F.max("n").alias(f"most_{side}")))  # noqa: E731  a row an id of a vocabulary
    joined = both.join(most("a"), "a").join(most("b"), "b")
    return joined.select("pair", "a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least n such that at most ``most`` pairs have it or more: from a histogram of n, read from its top."""
    left, least = most, 2**62
    for n, rows in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if rows > left:
            break
        left, least = left - rows, n
    return least


def alignment_statistics(aligned: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """Adds to stored alignments: n_links, n_best_a and n_best_b (links whose pair is the most frequent of its id of that side), count_sum (corpus counts summed over links)."""
    counts = stored(pair_counts(aligned), "pair-table")
    least = _frequent(counts, broadcast_rows)
    table = counts.select("pair", "n", "best_a", "best_b")
    looked = _links(aligned).join(F.broadcast(table.where(F.col("n") >= least)), "pair", "left")
    rare = looked.where("n is null").select("row", "times", "pair").join(table.where(F.col("n") < least), "pair")
    every = looked.where("n is not null").select("row", "times", "n", "best_a", "best_b").unionByName(rare.drop("pair"))
    own = lambda c: F.sum(F.when(F.col(c), F.col("times")).otherwise(0))
    sums = every.groupBy("row").agg(F.sum("times").alias("n_links"), own("best_a").alias("n_best_a"), own("best_b").alias("n_best_b"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return aligned.join(sums, "row", "left").na.fill(0, ["n_links", "n_best_a", "n_best_b", "count_sum"])
