"""Near-duplicate components against all pairs in plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import ngram_join
from strandline.llm.components import components
from strandline.llm.ngram_join import divide_skip, linked, merged_lists, near_duplicate_components
from strandline.llm.wordhash import shingle_sets


def plain_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def plain_components(texts, k, num, den):
    sets, root = plain_sets(texts, k), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [draw.choice(vocabulary) for _ in range(30)]
    texts = [None, "", "  \t ", "one", "One two", "one TWO", "a b c d", "A B C D", "É é b c", "é É b c"]
    base = [draw.choice(vocabulary) for _ in range(60)]
    for i in range(90):  # a family about the threshold, too large for a short list
        w = list(base)
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        texts.append(" ".join(w))
    for _ in range(60):  # unrelated texts that share a passage
        w = [draw.choice(vocabulary) for _ in range(draw.randint(20, 80))]
        at = draw.randrange(len(w))
        texts.append(" ".join(w[:at] + passage + w[at:]))
    texts += [texts[-1]] * 30 + [" ".join(base * 40)]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_components_equal_all_pairs(spark, k, num):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS component_id", "3 AS n").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_components(df, k=k, num=num, short=8, block=16, broadcast_rows=20 * (k == 4)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts, k, num, 100)


def test_empty_table_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert near_duplicate_components(df.limit(0)).collect() == []
    rows = near_duplicate_components(df).collect()
    assert len(rows) == 3 and all(r["component_id"] == 3 for r in rows)


def test_templates_do_not_merge_their_own_lists(spark, monkeypatch):
    """Short texts of one template: what is merged stays linear, and links between close ones are still found."""
    seen = {}
    keep = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: seen.setdefault(name, keep(df, name)))
    texts = [f"posted by the admin u{i}" for i in range(600)] + [f"u{i} wrote this in the forum" for i in range(300)]
    long_ = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    texts += [f"v{i} {long_} {long_[::-1]}" for i in range(40)]  # one shingle of 33 differs
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_components(df, k=4, num=85, block=16).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts, 4, 85, 100)
    merged = seen["merged-lists"]
    members = {r["a"] for r in merged.where("kind = 1").collect()}
    assert len(members) <= 40 and merged.where("kind = 0").count() <= 40 * 39 // 2


def test_merged_lists_beyond_the_needed_are_short():
    levels = np.array([0] * 10 + [3] * 10 + [9] * 80)
    assert merged_lists(levels, 85, 100) == (20, 5)
    assert merged_lists(np.full(100, 9), 85, 100) == (16, 1)
    assert merged_lists(np.zeros(100, np.uint8), 85, 100) == (22, 7)
    assert merged_lists(np.zeros(1, np.uint8), 85, 100) == (1, 1)


def test_shingle_sets_over_slices():
    texts = corpus(2)
    column = pa.array(["pad", *texts])[1:]
    for own, plain in zip(shingle_sets(column, 4), plain_sets(texts, 4)):
        assert len(own) == len(plain)
    again = shingle_sets(pa.array(texts[::-1]), 4)[::-1]
    assert all(np.array_equal(a, b) for a, b in zip(shingle_sets(column, 4), again))


def test_divide_skip_finds_spanning_links():
    sets = [s for s in shingle_sets(pa.array(corpus(3)), 4)]
    for queries, index, same in ((sets, sets, True), (sets[:80], sets[80:], False)):
        links = list(divide_skip(queries, index, 85, 100, same))
        assert all(linked(queries[i], index[j], 85, 100) for i, j in links)
        shift = 0 if same else len(queries)
        for find_all in (True, False):
            root = list(range(shift + len(index)))

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            pairs = ((i, j) for i in range(len(queries)) for j in range(i + 1 if same else 0, len(index)) if linked(queries[i], index[j], 85, 100)) if find_all else links
            for i, j in pairs:
                root[find(j + shift)] = find(i)
            parts = {}
            for i in range(len(root)):
                parts.setdefault(find(i), set()).add(i)
            if find_all:
                wanted = {frozenset(p) for p in parts.values()}
        assert {frozenset(p) for p in parts.values()} == wanted


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and all(got[i] == 100 for i in range(100, 140)) and len(got) == 61
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
