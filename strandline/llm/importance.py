"""Importance resampling towards a target text distribution by hashed n-grams.

Words stand in a table of positions: texts become rows (row, chunk, pos, word), a window
with ``lead()`` over each chunk puts the following words beside each word, and runs of one
to ``order`` words are its n-grams.  An n-gram's bucket is the CRC-32 of its bytes modulo
``BUCKETS``.  The gain of a bucket compares how often target and corpus have it; a
document's weight is the sum of the gains of its n-grams, and the documents with the
highest weight plus Gumbel noise are drawn, which samples without replacement.

A chunk holds ``CHUNK`` words and the first ``order - 1`` of the next, so a long text is
many windows.  What is shuffled, once, is the chunks as strings: exploding, window and
hashing follow without another exchange.  The buckets of each position are stored, and
both the corpus counts and the weights read them.  Counts and gains have ``BUCKETS`` rows
at most, whatever the corpus, so gains are broadcast.  Ranks come from a range sort and the
numbers of rows before each of its partitions.

Null and empty texts have no words: no n-grams, weight 0, never drawn where ``least`` is 1
or more.  Whole texts are read, in windows of about 1 MB.  Each row is a document of its
own, also where keys or texts repeat; ties of scores go by key (null last), then by row.
Equal rows have equal weights and scores.  An empty corpus gives an empty result; an empty
target gives gains from the corpus alone.  Further columns are not read, so their names
clash with none here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import lean, slices, stored

#: Words of a chunk, and buckets of n-grams.
CHUNK, BUCKETS = 512, 10_000
_BETWEEN = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
#: Digits, ASCII letters and all bytes behind ASCII are kept, A-Z as a-z; others stand between words.
_TABLE = bytes(0x20 if b in _BETWEEN else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _chunks(text: bytes, order: int, window: int = 1 << 20) -> Iterator[bytes]:
    """The words of a text in chunks, each with the first words of the next; one empty chunk where it has none."""
    plain = text.translate(_TABLE)
    wide = CHUNK + order - 1
    held: list[bytes] = []
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + window)
        end = end if end >= 0 else len(plain)
        held += plain[at:end].split()
        full = (len(held) - order + 1) // CHUNK
        for i in range(0, full * CHUNK, CHUNK):
            yield b" ".join(held[i : i + wide])
        del held[: full * CHUNK]
        at = end
    for i in range(0, len(held), CHUNK):
        yield b" ".join(held[i : i + wide])
    if not plain.strip():
        yield b""


def word_chunks(texts: DataFrame, order: int = 3) -> DataFrame:
    """row, key, chunk, s: the words of each text (key, text) in chunks, joined by spaces."""
    kind = dict(texts.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                at, chunk, body = [], [], []
                for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    for n, s in enumerate(_chunks(text or b"", order)):
                        at.append(i)
                        chunk.append(n)
                        body.append(s)
                own = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("row").take(own), part.column("key").take(own), pa.array(chunk, pa.int32()), pa.array(body, pa.binary()).cast(pa.string())], names=["row", "key", "chunk", "s"])

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "key", "text")
    return numbered.mapInArrow(lean(run), f"row long, key {kind}, chunk int, s string").repartition("row", "chunk")


def position_table(texts: DataFrame, order: int = 3) -> DataFrame:
    """row, key, b1 .. b<order>: for each place the buckets of the n-grams that begin there; a row of nulls where a text has no words."""
    words = word_chunks(texts, order).select("row", "key", "chunk", F.posexplode(F.split("s", " ")).alias("pos", "w1"))
    here = Window.partitionBy("row", "chunk").orderBy("pos")
    beside = words.select("*", *(F.lead("w1", n - 1).over(here).alias(f"w{n}") for n in range(2, order + 1)))

    def bucket(n: int) -> Column:
        spaced = [c for i in range(1, n + 1) for c in (F.lit(" "), F.col(f"w{i}"))][1:]
        return F.when((F.col("w1") != "") & F.col(f"w{n}").isNotNull(), (F.crc32(F.concat(*spaced)) % BUCKETS).cast("short")).alias(f"b{n}")

    return beside.where(F.col("pos") < CHUNK).select("row", "key", *(bucket(n) for n in range(1, order + 1)))


def bucket_counts(positions: DataFrame, order: int = 3) -> DataFrame:
    """bucket, n: how many n-grams of all orders fall into each bucket that has any."""
    each = positions.select(F.explode(F.array(*(f"b{n}" for n in range(1, order + 1)))).alias("bucket"))
    return each.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain: thousandths of the log ratio of smoothed frequencies, floored; a row for every bucket that the corpus has."""
    total = lambda counts: counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0] + BUCKETS
    s, t = total(corpus), total(target)
    own = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["t"])
    ratio = (F.col("t").cast("double") + 1) * F.lit(s) / ((F.col("s").cast("double") + 1) * F.lit(t))
    return own.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weigh(positions: DataFrame, gains: DataFrame, order: int = 3) -> DataFrame:
    """row, key, n_words, n_features, weight of each document."""
    joined = positions
    for n in range(1, order + 1):
        joined = joined.join(F.broadcast(gains.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"g{n}"))), f"b{n}", "left")
    gain = sum((F.coalesce(f"g{n}", F.lit(0)) for n in range(1, order + 1)), F.lit(0))
    features = sum((F.count(f"b{n}") for n in range(1, order + 1)), F.lit(0))
    return joined.groupBy("row").agg(F.first("key").alias("key"), F.count("b1").alias("n_words"), features.alias("n_features"), F.sum(gain).alias("weight"))


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of the SHA-256 of ``seed:key``; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int, least: int) -> DataFrame:
    """Adds ``rank``: 1, 2, 3 ... for the best ``percent`` per cent of the documents with ``least`` words, null for all others."""
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]
    eligible = F.col("n_words") >= least
    sorted_ = stored(scored.where(eligible).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "score-order")
    parts = sorted(map(tuple, sorted_.groupBy("_part").count().collect()))
    before, so_far = [], 0
    for part, n in parts:
        before.append((part, so_far))
        so_far += n
    offsets = scored.sparkSession.createDataFrame(before, "_part int, _before long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = sorted_.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_before") + inside)
    rank = F.when(F.col("_rank") <= so_far * percent // 100, F.col("_rank")).alias("rank")
    return ranked.select(*scored.columns, rank).unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least: int = 20, order: int = 3, seed: int = 42) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document; those with a rank are the sample."""
    corpus = stored(position_table(df.select(F.col(key).alias("key"), F.col(text).alias("text")), order), "positions")
    wanted = position_table(target.select(F.lit(0).alias("key"), F.col(target_text).alias("text")), order)
    gains = stored(bucket_gains(stored(bucket_counts(corpus, order), "corpus-buckets"), stored(bucket_counts(wanted, order), "target-buckets")), "gains")
    scored = stored(weigh(corpus, gains, order).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)), "scores")
    return drawn(scored, percent, least).select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")
