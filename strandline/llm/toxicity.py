"""Counterfactual-regularised toxicity classifier.

A logistic model over hashed words and word beginnings is fitted to labelled texts with a
penalty on counterfactuals: in labelled sentences, an identity term is swapped for
another term of its kind (or put into a sentence without one, where the sentence's
label is neutral), and the squared change of the score's logit is penalised, over all
features of both sentences: words, word beginnings and their counts.  Naming a
group then does not move the score, and neutral mentions are not taken for toxic ones
even where identity terms and toxic labels coincide in the sample.

The model is fitted in one task on a bounded sample: at most ``sample`` distinct labelled
rows, chosen by a hash of their key; a row that is repeated counts as often.  Words that fewer than ``least`` sampled texts have get
no weight, unless they are features of identity terms.  Scoring sees words only; no label, language, source or key.

Null and empty texts have no words and get the score of the bias.  Whole texts are read,
in slices of about 1 MB, a longer text alone.  Null labels are not used; a text with
several labels is used with each.  Ties of the hash go by key, label and text; repeated
rows get equal scores.  Without usable labels, all scores are one half; an empty table
gives an empty result.  Further columns are not read, and clash with none here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import lean, slices
from .wordhash import text_buffer, word_prefixes, words

#: Identity terms by kind; swaps stay within a kind.
IDENTITY = {
    "gender": "women men woman man girls boys female male transgender nonbinary frauen männer femmes hommes mujeres hombres".split(),
    "religion": "muslims muslim christians christian jews jewish hindus hindu buddhists atheists catholics protestants islam christianity judaism".split(),
    "origin": "black white asian latino african arab european american mexican chinese indian immigrants refugees foreigners natives".split(),
    "orientation": "gay lesbian bisexual straight homosexual heterosexual queer".split(),
    "ability": "deaf blind disabled autistic elderly young old".split(),
}
_EDGES = b".,;:!?\"'()[]"


def features(column: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of each hashed word and word beginning of each text; values are logarithms of counts.

    Punctuation is read as white space, so that a word counts wherever it stands.
    ``wanted`` tells which buckets matter.
    """
    raw, offsets = text_buffer(column)
    raw = raw.copy()
    raw[_PUNCTUATION[raw]] = 0x20
    hashes, text = word_prefixes(raw, offsets, BEGINNINGS)
    bucket = hashes >> np.uint64(64 - bits)
    if wanted is not None:
        kept = np.flatnonzero(wanted[bucket.astype(np.int64)])
        bucket, text = bucket[kept], text[kept]
    found, counts = np.unique(text.astype(np.uint64) << np.uint64(bits) | bucket, return_counts=True)
    return (found >> np.uint64(bits)).astype(np.int64), (found & np.uint64((1 << bits) - 1)).astype(np.int32), np.log2(1.0 + counts).astype(np.float32)


def word_bucket(word: str, bits: int) -> int:
    raw, offsets = text_buffer(pa.array([word]))
    return int(words(raw, offsets)[0][0] >> np.uint64(64 - bits))


#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(_EDGES)] = True


def term_features(bits: int) -> dict[str, list[np.ndarray]]:
    """Buckets of each identity term, by kind: its word's first, then those of its beginnings."""

    def of(term: str) -> np.ndarray:
        return (word_prefixes(*text_buffer(pa.array([term])), BEGINNINGS)[0] >> np.uint64(64 - bits)).astype(np.int64)

    return {kind: [of(t) for t in terms] for kind, terms in IDENTITY.items()}


def counterfactuals(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(pair, bucket, change of value) between two versions of labelled sentences, and the number of pairs.

    Each identity term of a sentence is swapped, wherever it stands, for another term of its
    kind (in turn), and taken out where the sentence's label is neutral.  A term, and the
    next one of its kind, is put into each neutral sentence without one, in turn, and so
    that each term is put somewhere if there is a neutral sentence at all.
    """
    kinds = list(term_features(bits).values())
    terms = [(k, i) for k, own in enumerate(kinds) for i in range(len(own))]
    of_word = {int(kinds[k][i][0]): (k, i) for k, i in terms}
    out: list[tuple[int, int, float]] = []
    n = 0

    def add(have: dict[int, int], go: np.ndarray, come: np.ndarray, times: int, start: tuple[int, ...] = ()) -> None:
        """A pair: the sentence (with ``start`` added) and that without ``go`` and with ``come``."""
        nonlocal n
        change: dict[int, int] = {}
        for f, d in [*((int(f), -times) for f in go), *((int(f), times) for f in come)]:
            change[f] = change.get(f, 0) + d
        for f, d in change.items():
            was = have.get(f, 0) + start.count(f)
            if d:
                out.append((n, f, float(np.log2(1 + max(was + d, 0)) - np.log2(1 + was))))
        n += 1

    none, bare = np.zeros(0, np.int64), []
    for row, (words_, value, label) in enumerate(zip(rows, values, labels)):
        found = [int(t) for t in words_ if int(t) in of_word]
        have = dict(zip(words_.tolist(), np.rint(2.0 ** value.astype(float) - 1).astype(int).tolist())) if found or not label else {}
        for t in found:
            k, i = of_word[t]
            own, times = kinds[k], have[t]
            add(have, own[i], own[(i + 1 + row % (len(own) - 1)) % len(own)], times)
            if not label:
                add(have, own[i], none, times)
        if not found and not label:
            bare.append(have)
    for j in range(max(len(bare), len(terms)) if bare else 0):
        have, (k, i) = bare[j % len(bare)], terms[j % len(terms)]
        own = kinds[k]
        add(have, none, own[i], 1)
        add(have, own[i], own[(i + 1) % len(own)], 1, tuple(own[i].tolist()))
    if not out:
        return none, none, np.zeros(0), n
    pair, bucket, change = zip(*out)
    return np.array(pair), np.array(bucket), np.array(change), n


def fit_weights(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, bits: int, times: np.ndarray | None = None, least: int = 8, penalty: float = 2.0, decay: float = 3e-4, rounds: int = 200) -> np.ndarray:
    """Weights (bias last) by full-batch Adam on the logistic loss, weight decay and the counterfactual penalty; ``times`` says how often each row counts."""
    dim = 1 << bits
    w = np.zeros(dim + 1)
    if not len(rows):
        return w
    pair, bucket, change, n_pairs = counterfactuals(rows, values, labels, bits)
    lengths = np.array([len(r) for r in rows])
    idx = np.concatenate(rows)
    seen = np.bincount(idx, minlength=dim)
    kept = seen >= least
    kept[np.concatenate([f for own in term_features(bits).values() for f in own])] = True
    used = np.flatnonzero(kept)
    place = np.full(dim + 1, -1)
    place[used] = np.arange(len(used))
    at = np.repeat(np.arange(len(rows)), lengths)
    keep = place[idx] >= 0
    col, at, val = place[idx[keep]], at[keep], np.concatenate(values)[keep]
    k = len(used)
    turned = place[bucket]
    v, m, s = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    times = np.ones(len(rows)) if times is None else times
    share = float((labels * times).sum() / times.sum())
    weight = np.where(labels == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) * times / times.sum()
    for step in range(1, rounds + 1):
        z = np.bincount(at, weights=v[col] * val, minlength=len(rows)) + v[k]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        grad = np.append(np.bincount(col, weights=g[at] * val, minlength=k), g.sum())
        grad[:k] += decay * v[:k]
        if n_pairs:
            moved = np.bincount(pair, weights=v[turned] * change, minlength=n_pairs)
            grad[:k] += np.bincount(turned, weights=(2 * penalty / n_pairs) * moved[pair] * change, minlength=k)
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        v -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    w[used], w[dim] = v[:k], v[k]
    return w


def score(column: pa.Array, w: np.ndarray, bits: int) -> np.ndarray:
    """P(toxic) of each text from its words."""
    text, bucket, value = features(column, bits, w[:-1] != 0)
    z = np.bincount(text, weights=w[bucket] * value, minlength=len(column)) + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def held_out(key: Column) -> Column:
    """Keys whose CRC-32 (as text) is a multiple of five."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 8_000, bits: int = 18) -> np.ndarray:
    """Weights fitted to at most ``sample`` labelled rows that are not held out."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, values, marks, times = [], [], [], []
        for batch in batches:
            for part in slices(batch, "text"):
                text, bucket, value = features(part.column("text"), bits)
                ends = np.cumsum(np.bincount(text, minlength=part.num_rows))[:-1]
                rows += np.split(bucket, ends)
                values += np.split(value, ends)
                marks.append(part.column("label").to_numpy())
                times.append(part.column("n").to_numpy())
        w = fit_weights(rows, values, np.concatenate(marks).astype(float), bits, np.concatenate(times).astype(float)) if marks else np.zeros((1 << bits) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    chosen = usable.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key", "label").limit(sample)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").groupBy("key", "label", "text").agg(F.count("*").alias("n"))
    found = rows.orderBy(F.xxhash64("key"), "key", "label", "text").limit(sample).select("text", "label", "n").mapInArrow(lean(train), "weights binary").first()
    return np.frombuffer(found[0], dtype=np.float64) if found else np.zeros((1 << bits) + 1)


def classify(df: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    kind = dict(df.dtypes)[key]
    bits = (len(weights) - 1).bit_length() - 1
    held = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value = score(part.column("text"), held.value, bits)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    scored = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"`{key}` {kind}, score double, predicted int")
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", "predicted")
