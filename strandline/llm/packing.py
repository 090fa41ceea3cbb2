"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Documents (cut into pieces where longer than a sequence) and the gaps of open
sequences are both sorted by size.  A sweep gives each document the smallest gap that
holds it; documents that want the same gap are told apart by rank, so that the i-th
document gets the i-th such gap; the rest open new sequences; gaps shrink by what they
took; and the sweep repeats until no document is left.

Sizes are whole numbers up to the sequence length, so documents of one size, and
sequences with one content, are interchangeable.  A round therefore works on classes
(size, count): at most ``capacity`` of them, however many documents there are.  The
sweep over classes yields runs of ranks, and every document finds its place from its
rank in its size by one join with those runs.  A sweep of a size splits one class of gaps
at most and opens one, so classes and runs are bounded by the capacity, whatever the
number of documents; the runs are broadcast up to ``broadcast_rows``, else joined by a
shuffle.  Only ranking shuffles rows, and rows are a few numbers; no text moves.

Null and empty texts have the closing id only.  Whole texts are encoded, in slices of
about 1 MB, a longer text alone.  Ties between equal sizes go by a hash of key, piece and
ids, then by these; repeated rows are documents of their own, each packed, and a null key
is a key like any other.  An empty table gives an empty result.  Further columns are not
returned, and clash with none here.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import lean, slices, stored
from .wordhash import range_hashes, text_buffer

_SPACE = 0x20
#: Bytes that are white space or may begin a white-space character in UTF-8.
_BEFORE_WORD = np.ones(256, dtype=bool)
_BEFORE_WORD[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_ASCII_WORD = np.ones(256, dtype=bool)
_ASCII_WORD[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False
#: Bytes that stand before the last byte of a white-space character in UTF-8.
_BEFORE_LAST = np.zeros(256, dtype=bool)
_BEFORE_LAST[[0xC2, 0x80, 0x81, 0x9A]] = True
_MARK, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARK[list(b",.;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def segment_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing their ids: at each text, at each single space between characters that are not white space, and at punctuation behind a letter.

    No pattern of a byte-level pre-tokenizer goes from a character that is not white
    space on to a space, nor from a letter on to a mark, so what follows is encoded by
    itself.  Where bytes leave a doubt there is no cut.
    """
    cut = np.zeros(len(raw) + 1, dtype=bool)
    if len(raw) > 2:
        space = np.flatnonzero(raw[1:-1] == _SPACE) + 1
        before, after = raw[space - 1], raw[space + 1]
        doubtful = (before >= 0x80) & _BEFORE_LAST[raw[np.maximum(space - 2, 0)]]
        cut[space[_ASCII_WORD[before] & ~doubtful & _BEFORE_WORD[after]]] = True
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        cut[edges - 1] = False  # the last byte of a text; its neighbour is in another text
        inner = edges[raw[edges] == _SPACE]
        cut[inner] = False
        cut[1:-1] |= _MARK[raw[1:]] & _LETTER[raw[:-1]]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut[: len(raw)])


class Encoder:
    """Ids of a byte-level BPE vocabulary for whole batches.

    Texts are cut at safe places (:func:`segment_starts`); each distinct segment of a
    batch is encoded once and remembered (at most ``most`` of them), and the batch's ids
    are gathered with numpy.  A 64-bit hash finds a segment, its bytes confirm it; a batch
    in which two segments share a hash is encoded text by text.
    """

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._forget()

    def _forget(self) -> None:
        self.keys, self.ids, self.bytes = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.known = np.zeros((0, 4), np.int64)  # of each key: first id, ids, first byte, bytes

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _learn(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        body = raw.tobytes()
        ids, counts = self._encode([body[a : a + n].decode("utf-8") for a, n in zip(starts.tolist(), lengths.tolist())])
        new = np.stack([len(self.ids) + np.cumsum(counts) - counts, counts, len(self.bytes) + np.cumsum(lengths) - lengths, lengths], axis=1)
        self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, _gather(raw, starts, lengths)])
        merged, known = np.concatenate([self.keys, keys]), np.concatenate([self.known, new])
        order = np.argsort(merged, kind="stable")
        self.keys, self.known = merged[order], known[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the total)."""
        raw, offsets = text_buffer(column)
        starts = segment_starts(raw, offsets)
        lengths = np.diff(np.append(starts, len(raw)))
        keys, first, inverse = np.unique(range_hashes(raw, starts, starts + lengths), return_index=True, return_inverse=True)
        is_known = np.isin(keys, self.keys, assume_unique=True)
        if len(self.keys) + np.count_nonzero(~is_known) > self.most:
            self._forget()
            is_known[:] = False
        if not is_known.all():
            new = first[~is_known]
            self._learn(keys[~is_known], raw, starts[new], lengths[new])
        id_at, n_ids, byte_at, n_bytes = self.known[np.searchsorted(self.keys, keys)].T
        if not np.array_equal(n_bytes[inverse], lengths) or not np.array_equal(_gather(self.bytes, byte_at[inverse], lengths), raw):
            ids, counts = self._encode([t or "" for t in column.to_pylist()])
            return ids, np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(n_ids[inverse])])
        return _gather(self.ids, id_at[inverse], n_ids[inverse]), total[np.searchsorted(starts, offsets)]


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + count]`` one after another."""
    before = np.cumsum(counts) - counts
    return values[np.repeat(starts - before, counts) + np.arange(counts.sum())]


_PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenised_pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, closing: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32): a text's ids and ``closing``, cut from its end into full pieces.

    The first piece of a longer document is the remainder, the others are full.
    """
    kind = dict(df.dtypes)[key]
    end = np.array([closing], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = encoder.encode(part.column("text"))
                ids = ids.astype("<u4", copy=False)
                at, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
                    own = ids[a:b].tobytes() + end
                    total = len(own) // 4
                    edges = [0, *range(total % capacity or capacity, total + 1, capacity)]
                    for n, (x, y) in enumerate(zip(edges, edges[1:])):
                        at.append(i)
                        piece.append(n)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(own[4 * x : 4 * y]))
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(at, pa.int64())), *(pa.array(x, f.type) for x, f in zip((piece, start, length, crc), _PIECES))], names=[key, *_PIECES.names])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over classes: runs (size, first rank, count, first sequence, offset).

    ``sizes`` has the number of pieces of each size.  Documents of rank r in the run take
    offset ``offset`` of sequence ``first sequence + r - first rank``.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> heap of (first sequence, count)
    order: list[int] = []  # gaps in ascending order
    sequences = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            heapq.heappush(gaps[gap], (first, count))

    for size in sorted(sizes, reverse=True):
        rank, left = 0, sizes[size]
        while left:  # a round: this size's documents against all gaps as they now are
            taken = []
            for gap in order[bisect_left(order, size) :]:
                while left and gaps[gap]:
                    first, count = heapq.heappop(gaps[gap])
                    n = min(left, count)
                    runs.append((size, rank, n, first, capacity - gap))
                    taken.append((gap - size, first, n))
                    if n < count:
                        heapq.heappush(gaps[gap], (first + n, count - n))
                    rank, left = rank + n, left - n
                if not left:
                    break
            if not taken:
                n = -(-left // (capacity // size))
                runs.append((size, rank, min(n, left), sequences, 0))
                taken.append((capacity - size, sequences, n))
                sequences, rank, left = sequences + n, rank + n, left - n
            for gap in [g for g in order if not gaps[g]]:
                del gaps[gap]
                order.remove(gap)
            for gap, first, n in taken:
                put(gap, first, n)
    return runs


def ranked(pieces: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """Adds each piece's rank in its length: by hash bucket first, then inside the bucket; no task sees a whole length."""
    b = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy(*order)
    numbered = b.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_at")).drop("_bucket", "_at", "_before")


def run_table(sizes: dict[int, int], runs: list[tuple[int, int, int, int, int]]) -> pa.Table:
    """(length, width, bucket, low, high, first, at): the runs by buckets of ``width`` ranks.

    A size's ranks are cut into as many buckets as it has runs, so a run lies in two
    buckets on average and a rank meets few runs in its bucket.
    """
    size, low, count, first, offset = (np.array(c, dtype=np.int64) for c in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 5
    kinds, inverse, many = np.unique(size, return_inverse=True, return_counts=True)
    width = (-(-np.array([sizes[k] for k in kinds.tolist()], dtype=np.int64) // many))[inverse] if runs else size
    begin, end = low // np.maximum(width, 1), (low + count - 1) // np.maximum(width, 1)
    n = end - begin + 1
    which = np.repeat(np.arange(len(size)), n)
    bucket = begin[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return pa.table({"length": size[which], "width": width[which], "bucket": bucket, "low": low[which], "high": (low + count)[which], "first": first[which], "at": offset[which]})


def pack(pieces: DataFrame, order: list[str], capacity: int = 2048, buckets: int = 32, broadcast_rows: int = 500_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every piece.

    The driver gets one count for each length (at most ``capacity`` rows) and sends back
    the swept runs; both are bounded by the capacity, not by the number of pieces.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    runs = run_table(counts, sweep(counts, capacity))
    plan = pieces.sparkSession.createDataFrame(runs)
    widths = plan.select("length", "width").distinct()
    placed = ranked(pieces, order, buckets).join(F.broadcast(widths), "length").withColumn("bucket", F.expr("_rank div width")).drop("width")
    found = placed.join(F.broadcast(plan.drop("width")) if runs.num_rows <= broadcast_rows else plan.drop("width").hint("merge"), ["length", "bucket"]).where("_rank >= low and _rank < high")
    return found.withColumn("sequence_id", F.expr("first + _rank - low")).withColumnRenamed("at", "offset").drop("bucket", "low", "high", "first", "_rank")


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    pieces = stored(tokenised_pieces(df, tokenizer, key, text, capacity), "pieces")
    return pack(pieces, [key, "piece", "ids_crc32"], capacity).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
