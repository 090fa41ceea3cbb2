"""Cross-entropy difference scores from matched n-gram models.

A target model (texts of a target set) and a background model (all other texts) share one
vocabulary, one n-gram inventory and one smoothing.  A document's score is the mean
over its words of the target model's loss less the background model's, in bits: the
lower, the more it is like the target set.

Vocabulary and inventory are exact and grow with the corpus: each word, each context and
each bigram has a count of its own in both models (62-bit hashes stand for them).  The
smoothed chance of a word after another is a mixture of its bigram's share and its
unigram share.  The background model is scaled to the target's size by its shares, so
neither model gains by size.

Counts are a table distributed by hash and never gathered.  Texts are stored in slices of
a few MB; each slice sends its distinct n-grams with its own counts to the buckets of
their hashes, each bucket sums them over the corpus and answers every slice with the
totals of what it sent, and the stored texts are scored with their slice's answers.  The
driver sees three sums.  A caller may still limit the ``vocabulary`` to the most frequent
words (ties by hash); all others then fall into ``classes`` classes by hash.

Null and empty texts have no words and score 0.  Whole texts are read, in slices of a few
MB, a longer text alone.  Repeated rows count as often as they occur and get equal scores.
With an empty target set both models differ by smoothing alone; an empty table gives an
empty result.  Further columns are not read, and clash with none here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import lean, most_frequent, slices, stored
from .wordhash import mix, text_buffer, words

@dataclass
class Vocabulary:
    """Sorted hashes of the words that differ; all other words have classes."""

    hashes: np.ndarray
    classes: int

    def mapped(self, hashes: np.ndarray) -> np.ndarray:
        """The words' hashes, and for words not in it their classes."""
        other = hashes % np.uint64(self.classes)
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, hashes, other)


def fit_vocabulary(df: DataFrame, text: str = "text", vocabulary: int = 50_000, classes: int = 4096) -> Vocabulary:
    """The most frequent words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(words(*text_buffer(part.column("text")))[0])
                size += len(held[-1])
                if size > 8_000_000:
                    yield flush()
                    size = 0
        yield flush()

    counted = df.select(F.col(text).alias("text")).mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = most_frequent(stored(counted, "word-counts"), vocabulary, "word")
    return Vocabulary(np.sort(np.array([r[0] for r in top.select("word").collect()], dtype=np.int64).view(np.uint64)), classes)


WORD, START, BIGRAM = 0, 1, 2
_START = np.uint64(0x57A27)


def _keys(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Hashes whose last two bits tell the kind."""
    with np.errstate(over="ignore"):
        return (mix(hashes + np.uint64(kind + 1)) & ~np.uint64(3)) | np.uint64(kind)


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, after the size of the planes."""
    planes = np.ascontiguousarray(values.reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(body: pa.BinaryScalar, kind: type) -> np.ndarray:
    raw = body.as_buffer()
    planes = pa.decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


@dataclass
class Slice:
    """The n-grams of a slice of texts.

    ``keys`` are sorted and distinct: words, the start of a text, bigrams.  ``at`` has the
    places in them of each word, of the one before it and of their bigram.
    """

    keys: np.ndarray
    at: np.ndarray
    text: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, vocabulary: Vocabulary | None) -> Slice:
        hashes, _, first = words(*text_buffer(column))
        if vocabulary is not None:
            hashes = vocabulary.mapped(hashes)
        begins = first[:-1][np.diff(first) > 0]
        before = np.roll(hashes, 1)
        before[begins] = _START
        with np.errstate(over="ignore"):
            pairs = mix(before * np.uint64(0xD6E8FEB86659FD93) + hashes)
        keys, at = np.unique(np.concatenate([_keys(hashes, WORD), _keys(np.array([_START]), START), _keys(pairs, BIGRAM)]), return_inverse=True)
        word, start, pair = np.split(at, [len(hashes), len(hashes) + 1])
        context = np.roll(word, 1)
        context[begins] = start
        n = np.diff(first)
        return cls(keys, np.stack([word, context, pair], axis=1), np.repeat(np.arange(len(n)), n), n)

    def counts(self, target: np.ndarray) -> np.ndarray:
        """(keys, 4): how often each key occurs in the slice's target texts and in its others, and how often less as a context."""
        own, many = target[self.text], len(self.keys)
        found, contexts = (np.stack([sum(np.bincount(self.at[w, k], minlength=many) for k in kinds) for w in (own, ~own)], axis=1) for kinds in ((0, 2), (1,)))
        less = np.where(((self.keys & np.uint64(3)) == BIGRAM)[:, None], 0, found - contexts)
        return np.concatenate([found, less], axis=1)

    def score(self, table: np.ndarray, sums: Sums, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, target loss a word, background loss a word, difference) of each text; ``table`` has the corpus's counts of the keys."""
        loss = sums.losses(table, self.at, self.text, target)
        mean = np.stack([np.bincount(self.text, weights=loss[:, j], minlength=len(self.n)) for j in (0, 1)]) / np.maximum(self.n, 1)
        return self.n, mean[0], mean[1], mean[0] - mean[1]


@dataclass
class Sums:
    """What both models share: the words of the target and of the background, and the vocabulary's size."""

    totals: np.ndarray
    size: int
    mixture: float = 0.7
    smoothing: float = 0.5

    def losses(self, table: np.ndarray, at: np.ndarray, text: np.ndarray, target: np.ndarray) -> np.ndarray:
        """(words, 2): bits that each model needs for each word, without the word's own text."""
        totals = self.totals
        scale = np.array([1.0, totals[0] / max(totals[1], 1) if totals[0] else 1.0])
        model = np.where(target[text], 0, 1)
        rows = np.arange(len(text))

        def less_own(at: np.ndarray, table: np.ndarray) -> np.ndarray:
            _, back, n = np.unique(text.astype(np.int64) << 32 | at, return_inverse=True, return_counts=True)
            out = table[at].astype(float)
            out[rows, model] -= n[back]
            return np.maximum(out, 0) * scale

        lengths = np.bincount(text)[text] if len(text) else text
        size = np.repeat(totals[None, :].astype(float), len(text), axis=0)
        size[rows, model] -= lengths
        single = (less_own(at[:, 0], table[:, :2]) + self.smoothing) / (np.maximum(size, 0) * scale + self.smoothing * self.size)
        context = less_own(at[:, 1], table[:, :2] - table[:, 2:])
        paired = np.minimum(less_own(at[:, 2], table[:, :2]), context) / np.maximum(context, 1e-9)
        weight = self.mixture * context / (context + 1)
        return -np.log2(weight * paired + (1 - weight) * single)


def slice_texts(df: DataFrame, is_target: str, key: str, text: str, most: int = 8 << 20) -> DataFrame:
    """(slice, rows): all rows (key, text, target) in stored slices of about ``most`` bytes; ``is_target`` is a boolean column."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 32, [], 0

        def put() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            rows = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sink.getvalue().to_pybytes()])], names=["slice", "rows"])

        for batch in batches:
            for part in slices(batch, "text", most):
                if held and size + part.nbytes > most:
                    yield put()
                    at, held, size = at + 1, [], 0
                held.append(part)
                size += part.nbytes
        if held:
            yield put()

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(is_target), F.lit(False)).alias("target"))
    return stored(rows.mapInArrow(lean(cut), "slice long, rows binary"), "slices")


def rows_of(body: pa.BinaryScalar) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(keys, texts, targets) of a stored slice."""
    rows = pa.ipc.open_stream(body.as_buffer()).read_all().combine_chunks()
    key, text, target = (pa.concat_arrays(rows.column(c).chunks) for c in ("key", "text", "target"))
    return key, text, target.to_numpy(zero_copy_only=False)


def count_ngrams(sliced: DataFrame, vocabulary: Vocabulary | None, buckets: int) -> DataFrame:
    """(slice, bucket, totals, words, target, background): the corpus's counts of each slice's n-grams, bucket by bucket.

    The last three columns add up to the distinct words and to the words of either model.
    """
    held = sliced.sparkSession.sparkContext.broadcast(vocabulary)
    edges = np.array([(i << 64) // buckets for i in range(buckets)], dtype=np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, body in zip(batch.column("slice"), batch.column("rows")):
                _, texts, target = rows_of(body)
                own = Slice.of(texts, held.value)
                counts = own.counts(target).astype(np.int32)
                ends = np.append(np.searchsorted(own.keys, edges), len(own.keys))
                some = np.flatnonzero(np.diff(ends))
                bodies = [packed(np.diff(own.keys[ends[i] : ends[i + 1]], prepend=np.uint64(0))) for i in some], [packed(counts[ends[i] : ends[i + 1]].T.copy()) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()] * len(some), pa.int64()), pa.array(some, pa.int64()), *(pa.array(b, pa.binary()) for b in bodies)], names=["slice", "bucket", "asked", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in table.column("asked")]
        sizes = [len(x) for x in asked]
        keys, back = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.concatenate([unpacked(x, np.int32).reshape(4, -1) for x in table.column("counts")], axis=1)
        totals = np.stack([np.bincount(back, weights=c, minlength=len(keys)) for c in counts], axis=1).astype(np.int64)
        word = (keys & np.uint64(3)) == WORD
        once = [[int(x)] + [0] * (len(sizes) - 1) for x in (word.sum(), *totals[word, :2].sum(0))]
        bodies = [packed(totals[part].T.copy()) for part in np.split(back, np.cumsum(sizes)[:-1])]
        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "totals": pa.array(bodies, pa.binary()), **dict(zip(("words", "target", "background"), once))})

    asked = sliced.mapInArrow(lean(ask), "slice long, bucket long, asked binary, counts binary")
    return stored(asked.groupBy("bucket").applyInArrow(answer, "slice long, bucket long, totals binary, words long, target long, background long"), "ngrams")


def score(sliced: DataFrame, counted: DataFrame, vocabulary: Vocabulary | None, classes: int, kind: str, key: str = "doc_id") -> DataFrame:
    """(key, n_words, target_loss, background_loss, difference) of every row; losses are bits a word, keys of type ``kind``."""
    n, target, background = (x or 0 for x in counted.agg(F.sum("words"), F.sum("target"), F.sum("background")).first())
    known = n if vocabulary is None else len(vocabulary.hashes)
    sums = Sums(np.array([target, background]), known + classes + 1)
    held = sliced.sparkSession.sparkContext.broadcast(vocabulary)

    def run(_, texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        answers = answers.sort_by("bucket")
        table = np.concatenate([np.zeros((4, 0), np.int64), *(unpacked(x, np.int64).reshape(4, -1) for x in answers.column("totals"))], axis=1).T
        for body in texts.column("rows"):
            keys, rows, target = rows_of(body)
            scores = Slice.of(rows, held.value).score(table, sums, target)
            out.append(pa.table([keys, *map(pa.array, scores)], names=[key, "n_words", "target_loss", "background_loss", "difference"]))
        return pa.concat_tables(out)

    answers = counted.select("slice", "bucket", "totals")
    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, f"`{key}` {kind}, n_words long, target_loss double, background_loss double, difference double")


def cross_entropy_difference(df: DataFrame, target_keys: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 250_000, vocabulary: int | None = None, classes: int = 4096) -> DataFrame:
    """Scores all rows against the rows whose key is in ``target_keys``.

    Up to ``broadcast_rows`` keys are sent to the scan that stores the texts in slices;
    more are joined by one shuffle of the texts.
    """
    targets = target_keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_target", F.lit(True))
    rows = df.select(key, F.col(text))
    few = targets.count() <= broadcast_rows
    marked = rows.join(F.broadcast(targets) if few else targets.hint("merge"), key, "left")
    known = None if vocabulary is None else fit_vocabulary(df, text, vocabulary, classes)
    sliced = slice_texts(marked, "_target", key, text)
    # A bucket reads a share of all slices' n-grams: about 32 slices' worth at most.
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sliced.count() // 32)
    return score(sliced, count_ngrams(sliced, known, buckets), known, classes, dict(df.dtypes)[key], key)
