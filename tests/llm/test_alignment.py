"""Token alignment against a plain version over whole texts, and its odd rows."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import alignment
from strandline.llm.queries import op12_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


VISIBLE = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
HIDDEN = [b for b in range(256) if b not in VISIBLE]


def to_bytes(letters):
    """Bytes of a byte-level entry, by the rule that visible Latin-1 stands for itself."""
    return bytes(ord(c) if ord(c) < 256 else HIDDEN[ord(c) - 256] for c in letters)


def plain(documents):
    """Rows of the contract from whole texts, with sets of ends."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    rows, counts = [], Counter()
    for key, text in documents:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a = [to_bytes(a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            rows.append((key, [], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 300 else __import__("itertools").accumulate(map(len, parts))
        at_a, at_b = {e: i for i, e in enumerate(ends(parts_a))}, {e: i for i, e in enumerate(ends(parts_b))}
        links = [(at_a[e], at_b[e]) for e in sorted(at_a.keys() & at_b.keys())]
        counts.update((ids_a[i], ids_b[j]) for i, j in links)
        rows.append((key, ids_a, ids_b, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for key, ids_a, ids_b, links in rows:
        groups, x, y = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, ids_a[x : i + 1])) + "|" + ",".join(map(str, ids_b[y : j + 1])))
            x, y = i + 1, j + 1
        own = [(counts[ids_a[i], ids_b[j]], ids_b[j]) for i, j in links]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((key, len(ids_a), len(ids_b), len(links), len(links), sum(n == most[z] for n, z in own), sum(n for n, _ in own), digest))
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces  "), (5, "line\n\n next\t tab \n"), (6, "mark ▁ inside"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (8, "don't we'll  it's 3.14, a-b (c) déjà vu 中文 \U0001f600   x"), (9, "\x00\x01 ctrl\x7f"), (10, "same same"), (10, "same same"), (None, "no key"), (11, "x" * 5000), (12, "a " * 4000),
    (13, "　wide  em q́ z"), (14, "\x1c \x1d a\x85 b"), (15, "trailing "), (16, ","), (17, "﻿bom ﬁ Ａ"),
]


def as_table(found):
    return Counter(tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def written(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "key", "pairs", "n", "groups")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_agrees_with_a_plain_version_on_given_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert as_table(op12_token_alignment(spark, "/root/testdata/sf0.001")) == Counter(plain(rows))


def test_odd_rows(spark, tmp_path):
    assert as_table(op12_token_alignment(spark, written(spark, tmp_path, ODD))) == Counter(plain(ODD))


def test_empty_table(spark, tmp_path):
    assert op12_token_alignment(spark, written(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("most", [0, 1, 5, 1000])
def test_frequent_and_rare_pairs_meet_the_same_counts(spark, most):
    df = spark.createDataFrame([(i, f"word{i % 7} the and , {i}") for i in range(60)], "doc_id long, text string")
    aligned = alignment.align(df, A, B).cache()
    columns = ["key", "n_links", "n_best_a", "n_best_b", "count_sum"]
    found = Counter(tuple(r) for r in alignment.alignment_statistics(aligned, most).select(columns).collect())
    assert found == Counter(tuple(r) for r in alignment.alignment_statistics(aligned).select(columns).collect())
    assert Counter((r[0], r[1], r[3], r[4]) for r in found.elements()) == Counter((r[0], r[4], r[5], r[6]) for r in plain([(i, f"word{i % 7} the and , {i}") for i in range(60)]))


def test_merge_ends_and_windows():
    assert alignment.merge_ends([1, 3, 4, 9], [2, 3, 9]) == [(1, 1), (3, 2)]
    aligner = alignment.Aligner(A, B)
    texts = [t for _, t in ODD] * 2
    listed = lambda found: [(a, b, g, p.tolist(), t.tolist()) for a, b, g, p, t in zip(*found)]
    assert listed(aligner.align(texts)) == [x for t in texts for x in listed(aligner.align([t]))]


def test_windows_of_a_task_are_bounded_and_whole(spark, monkeypatch):
    rows = [(i, f"a text, number {i} " * (i % 9)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    columns = ["key", "n_a", "n_b", "n_groups", "groups"]
    wanted = Counter(map(tuple, alignment.align(df, A, B).select(columns).collect()))
    monkeypatch.setattr(alignment, "WINDOW", 50)
    assert Counter(map(tuple, alignment.align(df, A, B).select(columns).collect())) == wanted
