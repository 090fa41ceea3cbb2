"""Registered queries of this subpackage and, where SQL can express them, their SQL.

Each applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import alignment, decontam, importance, line_dedup, lm_scoring, media, ngram_join, packing, pii, quality, sharding, simhash, toxicity
from .runtime import stored, table

SECRET = "key of the registered query; a deployment passes its own"


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards by key, and where nine shards would put them."""
    base = sharding.topology(8)
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), base, grown=sharding.grow(base))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from weak labels alone."""
    ship(spark)
    documents = table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.fit(documents))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without line chunks that an earlier one has."""
    return line_dedup.dedup_line_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every document under a model of good documents less that under a model of all others."""
    ship(spark)
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op5_payload_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as chunked media, read back and described."""
    ship(spark)
    return media.media_features(table(spark, sf_dir, "documents"))


def op6_edit_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that occurs in a document within its error budget."""
    ship(spark)
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its validated numbers, dates and addresses."""
    ship(spark)
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), SECRET)
    return out.select("doc_id", "text", "n_values", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))).alias("spans"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of 2048."""
    import public_tokenizers

    ship(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under four-word shingles and Jaccard 0.85."""
    ship(spark)
    return ngram_join.near_duplicate_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    ship(spark)
    documents = table(spark, sf_dir, "documents")
    return toxicity.classify(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op11_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under SimHash of four-word shingles and four differing bits."""
    ship(spark)
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, and how usual its links are in all documents."""
    import public_tokenizers

    ship(spark)
    aligned = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    kept = stored(aligned.select("row", "key", "n_a", "n_b", "n_groups", digest, "pairs", "times"), "alignments")
    out = alignment.alignment_statistics(kept)
    return out.select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.col("n_best_b").alias("n_best"), "count_sum", "groups_sha256")


def op13_position_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five per cent of the documents, drawn towards the distribution of the benchmark's texts."""
    ship(spark)
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP3_SQL = line_dedup.SQL.format(documents="documents") + "SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE coalesce(left_text, '') END AS text, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed FROM documents d LEFT JOIN result r ON r.doc_id = d.doc_id"

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

OP13_SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (SELECT side, doc_id, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda i: array_to_string(ws[i:i + n - 1], ' '))))) AS g FROM w),
h AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(g))), lambda i: CAST('0x' || substr(hex(g), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT g FROM f), crc),
p AS MATERIALIZED (SELECT side, doc_id, b, count(*) AS n FROM f JOIN h ON h.g = f.g GROUP BY ALL),
c AS (SELECT b, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS t FROM p GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS BIGINT) AS gain FROM c),
d AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM p JOIN g ON g.b = p.b WHERE side = 0 GROUP BY doc_id),
x AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN d ON d.doc_id = w.doc_id WHERE side = 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_words >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r ON r.doc_id = x.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_hash_tree, op2_weak_quality, op3_line_chunks, op4_cross_entropy, op5_payload_chunks, op6_edit_decontam, op7_feistel_pii, op8_best_fit_packing, op9_divide_skip, op10_counterfactual_toxicity, op11_bit_sliced, op12_token_alignment, op13_position_ngrams)
}

SQL: dict[str, str] = {"op3_line_chunks": OP3_SQL, "op9_divide_skip": OP9_SQL, "op13_position_ngrams": OP13_SQL}
