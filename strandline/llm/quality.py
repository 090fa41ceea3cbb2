"""Quality classifier from weak labels.

Eight heuristic labellers, which overlap and err, each call a text good, bad or abstain.
Expectation-maximisation over the counts of vote patterns (at most 3**8 rows, whatever
the corpus) estimates how often each labeller is right and every pattern's posterior.
Posteriors then train a linear scorer on hashed byte trigrams and shares of repeated words, which generalises beyond
the labellers' thresholds and gives every text a score.

Votes and patterns cover all rows.  The scorer alone is fitted on a bounded sample: at
most ``sample`` distinct rows (a documented parameter), chosen and ordered by a hash of
their key and text, each weighted by how often it is repeated.  Rows that copy one text
are therefore drawn no more often than others, and one task holds ``sample`` rows at
most.  True labels are never used.

Null and empty texts abstain everywhere and get the prior as posterior; their score is
that of a text without trigrams.  Whole texts are read, in slices of about 1 MB, a longer
text alone.  Ties of the hash go by key and text.  Repeated rows count as often as they
occur and get equal scores; an empty table gives an empty result.  ``classify`` returns
its own columns only; ``filter_quality`` keeps all of the table's, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import lean, slices
from .wordhash import text_buffer, words

LABELLERS = ("symbols", "shouting", "exclaims", "tables", "repeats", "word_length", "variety", "common_words")
_U = np.uint64
#: Frequent function words of the languages served.
COMMON = "the of and to in is on it for as with that de la le les des et en que un der die und das ist el y los se".split()


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_IS_SYMBOL, _IS_UPPER, _IS_LETTER = _table("#$%&*<>{}[]\\^~=_@"), np.zeros(256, bool), np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True


def _hash_of(words_: list[str]) -> np.ndarray:
    raw, offsets = text_buffer(pa.array([" ".join(words_)]))
    return np.unique(words(raw, offsets)[0])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _repetition(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of words that equal the one before, distinct words over words) of each text."""
    some = np.maximum(np.diff(first), 1)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < len(hashes)]] = False
    again = np.diff(np.concatenate([[0], np.cumsum(same)])[first]) / some
    return again, np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:])], dtype=float) / some


def votes(column: pa.Array) -> np.ndarray:
    """(texts, labellers): 1 good, 2 bad, 0 abstains."""
    raw, offsets = text_buffer(column)
    hashes, _, first = words(raw, offsets)
    n_words = np.diff(first)
    some = np.maximum(n_words, 1)
    letters = np.maximum(_per_text(_IS_LETTER[raw], offsets), 1)
    share = lambda flags, of: _per_text(flags, offsets) / of
    symbols, upper = share(_IS_SYMBOL[raw], some), share(_IS_UPPER[raw], letters)
    exclaims, bars = share(raw == 33, some), share(raw == 124, some)
    length = letters / some
    known = np.isin(hashes, _hash_of(COMMON))
    common = np.diff(np.concatenate([[0], np.cumsum(known)])[first]) / some
    again, distinct = _repetition(hashes, first)
    rules = (  # good if, bad if
        (symbols < 0.02, symbols > 0.2),
        (upper < 0.15, upper > 0.4),
        (exclaims < 0.05, exclaims > 0.15),
        (bars < 0.02, bars > 0.15),
        (again < 0.05, again > 0.2),
        ((length > 2.5) & (length < 9), (length < 2) | (length > 14)),
        ((distinct > 0.45) | (n_words < 50), (distinct < 0.3) & (n_words >= 50)),
        (common > 0.08, (common < 0.02) & (n_words >= 20)),
    )
    out = np.stack([np.where(bad, 2, np.where(good, 1, 0)) for good, bad in rules], axis=1)
    out[n_words == 0] = 0
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def unpack(pattern: np.ndarray, m: int = len(LABELLERS)) -> np.ndarray:
    return np.asarray(pattern)[:, None] // (3 ** np.arange(m)) % 3


class LabelModel:
    """P(good) and each labeller's chances of its three answers given the truth."""

    def __init__(self, prior: float, tables: np.ndarray):
        self.prior, self.tables = prior, tables  # tables: labeller, truth (0 good, 1 bad), answer

    @classmethod
    def fit(cls, pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> LabelModel:
        """Expectation-maximisation from the votes' majority; a labeller's answers are independent given the truth."""
        v, m = unpack(pattern), len(LABELLERS)
        good, bad = (v == 1).sum(1), (v == 2).sum(1)
        post = (good + 1.0) / (good + 3.0 * bad + 2.0)
        total = max(count.sum(), 1)
        for _ in range(rounds):
            prior = (float((count * post).sum()) + 1) / (total + 2)
            tables = np.empty((m, 2, 3))
            for j in range(m):
                for y, p in ((0, post), (1, 1 - post)):
                    mass = np.array([(count * p)[v[:, j] == a].sum() for a in range(3)]) + np.array([0.5, 1.0 - 0.5 * y, 0.5 + 0.5 * y])
                    tables[j, y] = mass / mass.sum()
            model = cls(prior, tables)
            new = model.posterior(pattern)
            if np.abs(new - post).max(initial=0) < 1e-9:
                break
            post = new
        return model

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good | votes)."""
        v = unpack(pattern)
        log = np.log([self.prior, 1 - self.prior])[None, :].repeat(len(v), 0)
        for j in range(v.shape[1]):
            given = np.log(self.tables[j][:, v[:, j]]).T
            log += np.where((v[:, j] > 0)[:, None], given, 0)  # an abstention says nothing
        return 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right where it answers."""
        out = {}
        for j, name in enumerate(LABELLERS):
            right = self.prior * self.tables[j, 0, 1] + (1 - self.prior) * self.tables[j, 1, 2]
            wrong = self.prior * self.tables[j, 0, 2] + (1 - self.prior) * self.tables[j, 1, 1]
            out[name] = float(right / (right + wrong))
        return out


def trigram_buckets(raw: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of the byte trigram at each place (two fewer than bytes)."""
    if len(raw) < 3:
        return np.zeros(0, np.int32)
    x = raw.astype(np.uint32)
    code = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32)


def _repeats(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, EXTRA): root of the share of repeated words, and missing variety in longer texts."""
    hashes, _, first = words(raw, offsets)
    again, distinct = _repetition(hashes, first)
    return np.stack([np.sqrt(again), (1 - distinct) * np.minimum(np.diff(first), 200) / 200], axis=1)


def features(column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """The dense vector of each text: square roots of hashed trigram shares, then the two shares of repeated words."""
    raw, offsets = text_buffer(column)
    repeats = _repeats(raw, offsets)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        counts = np.bincount(trigram_buckets(raw[a:b], bits), minlength=1 << bits)
        yield np.concatenate([np.sqrt(counts / max(1, b - a - 2)), repeats[i]])


EXTRA = 2


def fit_scorer(columns: list[pa.Array], target: np.ndarray, bits: int, times: np.ndarray | None = None, epochs: int = 30, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a logistic scorer fitted to soft targets by Adam; ``times`` says how often each text counts."""
    dim = (1 << bits) + EXTRA
    w, m, s, step = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1), 0
    rows = [(i := np.flatnonzero(x), x[i]) for c in columns for x in features(c, bits)]
    times = np.ones(len(rows)) if times is None else times
    share = float((target * times).sum() / max(times.sum(), 1))
    balance = np.where(target >= 0.5, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) * times / max(times.mean(), 1) if rows else target
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 128)):
            if not len(batch):
                continue
            idx = np.concatenate([rows[i][0] for i in batch])
            val = np.concatenate([rows[i][1] for i in batch])
            at = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            z = np.bincount(at, weights=w[idx] * val, minlength=len(batch)) + w[dim]
            g = (1 / (1 + np.exp(-z)) - target[batch]) * balance[batch] / len(batch)
            grad = np.append(np.bincount(idx, weights=g[at] * val, minlength=dim), g.sum())
            grad[:dim] += decay * w[:dim]
            step += 1
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w


def score(column: pa.Array, w: np.ndarray, bits: int) -> np.ndarray:
    z = np.fromiter((x @ w[:-1] for x in features(column, bits)), dtype=float) + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class QualityModel:
    def __init__(self, labels: LabelModel, weights: np.ndarray, bits: int):
        self.labels, self.weights, self.bits = labels, weights, bits

    def apply(self, column: pa.Array) -> np.ndarray:
        """P(good) of each text, by the scorer."""
        return score(column, self.weights, self.bits)


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 6000, bits: int = 12) -> QualityModel:
    """Fits label model and scorer; ``sample`` bounds the rows that the scorer is fitted on."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                counts += np.bincount(patterns(votes(part.column("text"))), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found])], names=["pattern", "n"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(lean(vote), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    labels = LabelModel.fit(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float))
    total = sum(r[1] for r in rows)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, targets, times = [], [], []
        for batch in batches:
            for part in slices(batch, "text"):
                targets.append(labels.posterior(patterns(votes(part.column("text")))))
                texts.append(part.column("text"))
                times.append(part.column("n").to_numpy())
        w = fit_scorer(texts, np.concatenate(targets), bits, np.concatenate(times).astype(float)) if targets else fit_scorer([], np.zeros(0), bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    weights = sample_rows(df, key, text, sample, total).select("text", "n").mapInArrow(lean(train), "weights binary").first()
    return QualityModel(labels, np.frombuffer(weights[0], dtype=np.float64) if weights else np.zeros((1 << bits) + EXTRA + 1), bits)


def sample_rows(df: DataFrame, key: str, text: str, sample: int, total: int) -> DataFrame:
    """(key, text, n): at most ``sample`` distinct rows with a text, by a hash of key and text; ``n`` says how often each occurs.

    A threshold on the hash passes about ``sample`` of ``total`` rows; repeats of one row
    are counted where they are read, and the limit makes the bound hold for any table.
    """
    limit = int(2**31 * min(1.0, sample / max(total, 1)))
    drawn = F.pmod(F.xxhash64("key", "text"), F.lit(2**31))
    some = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).where(drawn < limit)
    return some.groupBy("key", "text").agg(F.count("*").alias("n")).orderBy(drawn, "key", "text").limit(sample)


def classify(df: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, keep) of every row; keep where the score is at least one half."""
    kind = dict(df.dtypes)[key]
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value = held.value.apply(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(value), pa.array(value >= 0.5)], names=[key, "score", "keep"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"`{key}` {kind}, score double, keep boolean")


def filter_quality(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the scorer keeps, with all columns; no shuffle."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(held.value.apply(part.column(text)) >= 0.5))

    return df.mapInArrow(lean(run), df.schema)
