"""The trained operators: held-out accuracy, brute-force scores, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import lm_scoring, quality, toxicity
from strandline.llm.runtime import table

DATA = "/root/testdata/sf0.01"
ODD = [(None, "null key text"), (-1, None), (-2, ""), (-3, "%%%"), (-4, "word " * 30_000), (-4, "word " * 30_000)]


def odd(spark, extra="1 AS score, 2 AS label, true AS keep"):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", *extra.split(", "))


# ---- quality


def test_quality_agrees_with_labels_it_never_saw(spark):
    documents = table(spark, DATA, "documents")
    model = quality.fit(documents)
    got = {r["doc_id"]: r["keep"] for r in quality.classify(documents, model).collect()}
    labels = table(spark, DATA, "labels").collect()
    right = [got[r["doc_id"]] == (r["quality"] == 1) for r in labels]
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1]
    assert np.mean(right) > 0.95 and np.mean(good) > 0.97
    assert all(a > 0.7 for a in model.labels.accuracies().values())
    kept = quality.filter_quality(documents, model)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k, v in got.items() if v}


def test_quality_of_odd_rows(spark):
    model = quality.fit(odd(spark))
    rows = quality.classify(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = odd(spark).limit(0)
    assert quality.classify(empty, quality.fit(empty)).collect() == []


def test_quality_sample_is_bounded_and_weighted(spark):
    """A text that a third of the rows copy, and rows that repeat, do not widen the sample."""
    rows = [(i, "copied text") for i in range(400)] + [(9_999, "one row")] * 400 + [(10_000 + i, f"own text {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for sample in (50, 300, 5_000):
        got = quality.sample_rows(df, "doc_id", "text", sample, len(rows)).collect()
        assert len(got) <= sample and len({(r["key"], r["text"]) for r in got}) == len(got)
        assert all(r["n"] == (400 if r["key"] == 9_999 else 1) for r in got)
    assert len(got) == 801 and sum(r["n"] for r in got) == 1200


def plain_votes(text):
    """The eight labellers by their rules, a word at a time."""
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n, raw = max(len(words), 1), (text or "").encode()
    if not words:
        return [0] * 8
    letters = max(sum(chr(b).isalpha() and b < 128 or b >= 128 for b in raw), 1)
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    distinct, size = len(set(words)) / n, letters / n
    common = sum(w in quality.COMMON for w in words) / n
    count = lambda chars: sum(chr(b) in chars for b in raw if b < 128)
    symbols, upper = count("#$%&*<>{}[]\\^~=_@") / n, sum(65 <= b <= 90 for b in raw) / letters
    marks, bars = count("!") / n, count("|") / n
    rules = [(symbols < 0.02, symbols > 0.2), (upper < 0.15, upper > 0.4), (marks < 0.05, marks > 0.15), (bars < 0.02, bars > 0.15), (again < 0.05, again > 0.2), (2.5 < size < 9, size < 2 or size > 14), (distinct > 0.45 or len(words) < 50, distinct < 0.3 and len(words) >= 50), (common > 0.08, common < 0.02 and len(words) >= 20)]
    return [2 if bad else 1 if good else 0 for good, bad in rules]


def test_votes_and_label_model_equal_plain_ones(spark):
    """Votes of whole texts, and expectation-maximisation over rows instead of patterns, in plain Python."""
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [r["text"] for r in documents.collect()] + [None, "", "A B c! | #"]
    found = quality.votes(pa.array(texts))
    plain = [plain_votes(t) for t in texts]
    assert found.tolist() == plain
    model = quality.fit(documents).labels
    rows = plain[:-3]
    post = [(sum(a == 1 for a in v) + 1.0) / (sum(a == 1 for a in v) + 3.0 * sum(a == 2 for a in v) + 2.0) for v in rows]
    for _ in range(100):
        prior = (sum(post) + 1) / (len(rows) + 2)
        tables = []
        for j in range(8):
            own = []
            for y in (0, 1):
                mass = [0.5, 1.0 - 0.5 * y, 0.5 + 0.5 * y]
                for v, p in zip(rows, post):
                    mass[v[j]] += p if y == 0 else 1 - p
                own.append([m / sum(mass) for m in mass])
            tables.append(own)
        new = []
        for v in rows:
            good, bad = math.log(prior), math.log(1 - prior)
            for j, a in enumerate(v):
                if a:
                    good, bad = good + math.log(tables[j][0][a]), bad + math.log(tables[j][1][a])
            new.append(1 / (1 + math.exp(max(-50, min(50, bad - good)))))
        moved = max(abs(a - b) for a, b in zip(new, post))
        if moved < 1e-9:
            break
        post = new
    assert model.prior == pytest.approx(prior, abs=1e-6) and np.allclose(model.tables, tables, atol=1e-6)
    scorer = quality.fit(documents)
    dense = np.zeros((1 << scorer.bits) + quality.EXTRA)
    text = texts[0]
    raw = text.encode()
    for i in range(len(raw) - 2):
        dense[((int.from_bytes(raw[i : i + 3], "little") * 0x9E3779B1) % 2**32) >> (32 - scorer.bits)] += 1
    dense = np.sqrt(dense / max(1, len(raw) - 2))
    words = [w.lower() for w in text.split()]
    again, distinct = sum(a == b for a, b in zip(words, words[1:])) / len(words), len(set(words)) / len(words)
    dense[-2:] = math.sqrt(again), (1 - distinct) * min(len(words), 200) / 200
    got = quality.classify(documents, scorer).where(f"doc_id = {documents.first()['doc_id']}").first()["score"]
    assert got == pytest.approx(1 / (1 + math.exp(-(dense @ scorer.weights[:-1] + scorer.weights[-1]))), abs=1e-9)


def test_label_model_finds_accuracies():
    draw = np.random.default_rng(1)
    truth = draw.random(20_000) < 0.8
    want = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.85, 0.7, 0.95])
    right = draw.random((20_000, 8)) < want
    votes = np.where(right == truth[:, None], 1, 2)
    votes[draw.random(votes.shape) < 0.3] = 0
    pattern, count = np.unique(quality.patterns(votes), return_counts=True)
    model = quality.LabelModel.fit(pattern, count.astype(float))
    assert np.allclose(list(model.accuracies().values()), want, atol=0.03) and abs(model.prior - 0.8) < 0.03
    assert ((model.posterior(quality.patterns(votes)) >= 0.5) == truth).mean() > 0.93


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    documents, labels = table(spark, data, "documents"), table(spark, data, "labels")
    scored = toxicity.classify(documents, toxicity.fit(documents, labels))
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    tested = [(rows[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([p == t for p, t in tested]) > 0.97
    assert np.mean([p for p, t in tested if not t]) < 0.02


def test_held_out_labels_do_not_matter(spark):
    documents, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert np.array_equal(toxicity.fit(documents, labels), toxicity.fit(documents, flipped))


def test_identity_terms_do_not_move_scores():
    """Identity terms that coincide with toxic labels lose their weight by the penalty."""
    draw = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        w = [draw.choice(words) for _ in range(20)]
        if toxic:
            w[3:5] = ["idiot", draw.choice(["muslims", "women", "immigrants"])]
        elif i % 50 == 1:
            w[4] = draw.choice(["muslims", "women", "immigrants"])
        texts.append(" ".join(w))
        labels.append(float(toxic))
    text, bucket, value = toxicity.features(pa.array(texts), 16)
    ends = np.cumsum(np.bincount(text, minlength=len(texts)))[:-1]
    rows, values = np.split(bucket, ends), np.split(value, ends)
    neutral = pa.array([" ".join(words[:8] + [t] + words[8:16]) for t in ("muslims", "women", "immigrants")])
    plain = toxicity.score(neutral, toxicity.fit_weights(rows, values, np.array(labels), 16, penalty=0.0), 16)
    fair = toxicity.score(neutral, toxicity.fit_weights(rows, values, np.array(labels), 16, penalty=200.0), 16)
    assert (fair < plain).all() and (fair < 0.5).all()
    assert toxicity.score(pa.array(["w1 idiot w2"]), toxicity.fit_weights(rows, values, np.array(labels), 16), 16)[0] > 0.5


def rows_of(texts, bits):
    text, bucket, value = toxicity.features(pa.array(texts), bits)
    ends = np.cumsum(np.bincount(text, minlength=len(texts)))[:-1]
    return np.split(bucket, ends), np.split(value, ends)


def test_counterfactuals_are_the_swapped_sentences_features():
    """The change of each pair is that between the feature vectors of the written-out sentences."""
    dense = lambda t: np.bincount(toxicity.features(pa.array([t]), 18)[1], weights=toxicity.features(pa.array([t]), 18)[2], minlength=1 << 18)
    text = "some muslims and immigrated muslims say muslin"
    pair, bucket, change, n = toxicity.counterfactuals(*rows_of([text], 18), np.array([0.0]), 18)
    wanted = [dense(text.replace("muslims", other)) - dense(text) for other in ("muslim", "")]
    assert n == 2
    for i in range(n):
        got = np.bincount(bucket[pair == i], weights=change[pair == i], minlength=1 << 18)
        assert np.allclose(got, wanted[i], atol=1e-5) and np.abs(wanted[i]).sum() > 1


def test_production_penalty_moves_whole_logits():
    """With the production penalty, terms that coincide with toxic labels hardly move a neutral sentence's logit."""
    draw = random.Random(2)
    words, biased = [f"w{i}" for i in range(200)], ("muslims", "women", "immigrants", "refugees")
    texts, labels = [], []
    for i in range(600):
        w = [draw.choice(words) for _ in range(20)]
        if i % 3 == 0:
            w[3:5] = ["idiot", draw.choice(biased)]
        texts.append(" ".join(w))
        labels.append(float(i % 3 == 0))
    rows, values = rows_of(texts, 18)
    logit = lambda t, w: (lambda p: np.log(p / (1 - p)))(toxicity.score(pa.array([t]), w, 18)[0])
    plain, fair = (toxicity.fit_weights(rows, values, np.array(labels), 18, **x) for x in ({"penalty": 0.0}, {}))
    neutral = " ".join(words[:16])
    for t in biased:
        moved = [abs(logit(f"{neutral} {t}", w) - logit(neutral, w)) for w in (plain, fair)]
        assert moved[1] < 0.2 * moved[0] and toxicity.score(pa.array([f"{neutral} {t}"]), fair, 18)[0] < 0.5
    assert toxicity.score(pa.array([f"{neutral} idiot"]), fair, 18)[0] > 0.5


def plain_toxicity(text, w, bits):
    """The logit from a word at a time: each word, and its first 4 to 8 bytes where it is longer."""
    clean = "".join(" " if c in ".,;:!?\"'()[]" else c for c in text or "")
    counts = Counter()
    for word in re.findall(rb"[^\x20\x09-\x0D]+", clean.lower().encode()):
        hashes, _ = toxicity.word_prefixes(*toxicity.text_buffer(pa.array([word.decode()])), toxicity.BEGINNINGS)
        assert len(hashes) == 1 + sum(len(word) > n for n in toxicity.BEGINNINGS)
        counts.update((hashes >> np.uint64(64 - bits)).tolist())
    return sum(w[b] * math.log2(1 + n) for b, n in counts.items()) + w[-1]


def test_toxicity_scores_equal_plain_ones(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    weights = toxicity.fit(documents, table(spark, "/root/testdata/sf0.001", "labels"))
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if (r["text"] or "").isascii()}
    scored = {r["doc_id"]: r["score"] for r in toxicity.classify(documents, weights).collect()}
    for key, text in list(texts.items())[:60]:
        assert scored[key] == pytest.approx(1 / (1 + math.exp(-plain_toxicity(text, weights, 18))), abs=1e-5)


def test_every_swap_of_a_kind_moves_scores_little():
    """With the production penalty, and labels that coincide with some terms, no swap within a kind moves a neutral sentence far."""
    draw = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    biased = [t for kind in toxicity.IDENTITY.values() for t in kind[:2]]
    texts, labels = [], []
    for i in range(900):
        w = [draw.choice(words) for _ in range(20)]
        if i % 3 == 0:
            w[3:5] = ["idiot", draw.choice(biased)]
        texts.append(" ".join(w))
        labels.append(float(i % 3 == 0))
    rows, values = rows_of(texts, 18)
    w = toxicity.fit_weights(rows, values, np.array(labels), 18)
    neutral = " ".join(words[:16])
    for terms in toxicity.IDENTITY.values():
        scores = toxicity.score(pa.array([f"{neutral} {t}" for t in terms]), w, 18)
        assert scores.max() - scores.min() < 0.1 and scores.max() < 0.5
    assert toxicity.score(pa.array([f"{neutral} idiot"]), w, 18)[0] > 0.5


def test_toxicity_sample_is_bounded_where_a_key_repeats(spark):
    rows = [(1, "bad bad words"), (2, "good words")] * 300 + [(i, f"other {i}") for i in range(3, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS n", "6 AS label")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    once = spark.createDataFrame(sorted(set(rows)), "doc_id long, text string")
    assert np.isfinite(toxicity.fit(df, labels, sample=10, bits=12)).all()
    assert len(toxicity.classify(df, toxicity.fit(once, labels, bits=12)).collect()) == len(rows)


def test_toxicity_of_odd_rows(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    rows = toxicity.classify(odd(spark), toxicity.fit(odd(spark), none)).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0.5 for r in rows)
    assert toxicity.classify(odd(spark).limit(0), toxicity.fit(odd(spark).limit(0), none)).collect() == []


# ---- language models


def plain_scores(texts, targets, vocabulary, classes, mixture=0.7, smoothing=0.5):
    """The same models with exact bigrams, by dictionaries."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    counts = Counter(w for words in split for w in words)
    assert len(counts) <= vocabulary
    uni, con, bi = ([Counter(), Counter()] for _ in range(3))
    for words, target in zip(split, targets):
        for a, b in zip(["<s>", *words], words):
            m = 0 if target else 1
            uni[m][b] += 1
            con[m][a] += 1
            bi[m][a, b] += 1
    totals = [sum(u.values()) for u in uni]
    scale = [1.0, totals[0] / max(totals[1], 1) if totals[0] else 1.0]
    size, out = len(counts) + classes + 1, []
    for words, target in zip(split, targets):
        own = [Counter(words), Counter(["<s>", *words][:-1]), Counter(zip(["<s>", *words], words))]
        loss = [0.0, 0.0]
        for a, b in zip(["<s>", *words], words):
            for m in (0, 1):
                mine = m == (0 if target else 1)
                u, c, p = ((max(t[m][k] - mine * o[k], 0)) * scale[m] for t, o, k in zip((uni, con, bi), own, (b, a, (a, b))))
                n = max(totals[m] - mine * len(words), 0) * scale[m]
                weight = mixture * c / (c + 1)
                loss[m] -= math.log2(weight * (min(p, c) / max(c, 1e-9)) + (1 - weight) * (u + smoothing) / (n + smoothing * size))
        out.append(tuple(x / max(len(words), 1) for x in loss))
    return out


@pytest.mark.parametrize("few", [250_000, 0])
def test_losses_equal_plain_models(spark, few):
    draw = random.Random(3)
    texts = [None, "", "Solo"] + [" ".join(draw.choice("abcdef") * draw.randint(1, 2) for _ in range(draw.randint(1, 60))) for _ in range(50)]
    targets = [i % 3 == 0 for i in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_words").repartition(3)
    keys = spark.createDataFrame([(i,) for i, t in enumerate(targets) if t] + [(None,), (0,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, keys, broadcast_rows=few, vocabulary=100, classes=8).collect()}
    for i, (a, b) in enumerate(plain_scores(texts, targets, 100, 8)):
        assert got[i]["target_loss"] == pytest.approx(a, abs=1e-9) and got[i]["background_loss"] == pytest.approx(b, abs=1e-9)
        assert got[i]["difference"] == pytest.approx(a - b, abs=1e-9)
    assert lm_scoring.cross_entropy_difference(df.limit(0), keys).collect() == []
    assert len(lm_scoring.cross_entropy_difference(odd(spark), keys.limit(0)).collect()) == len(ODD)


def test_losses_are_exact_beyond_any_fixed_table(spark):
    """More distinct words than 50,000 and more distinct bigrams than 2**20: counts stay those of brute force."""
    draw = random.Random(5)
    word = lambda: f"w{int(70_000 * draw.random() ** 1.2)}"
    texts = [" ".join(word() for _ in range(2_000)) for _ in range(650)]
    split = [t.split() for t in texts]
    assert len({w for t in split for w in t}) > 50_000 and len({p for t in split for p in zip(t, t[1:])}) > 1 << 20
    targets = [i % 3 == 0 for i in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    keys = spark.createDataFrame([(i,) for i, t in enumerate(targets) if t], "doc_id long")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, keys).collect()}
    for i, (a, b) in enumerate(plain_scores(texts, targets, 1 << 40, 4096)):
        assert got[i]["target_loss"] == pytest.approx(a, abs=1e-9) and got[i]["background_loss"] == pytest.approx(b, abs=1e-9)
