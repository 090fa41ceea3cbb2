"""A training-data pipeline over ``documents``: each stage keeps the columns but the last.

Stages: quality classifier, line dedup, near-duplicate removal, benchmark
decontamination, packing.  Each takes (spark, docs, sf_dir) and works on all that its
predecessor kept.  ``run`` applies them, storing what each returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, line_dedup, ngram_join, packing, quality
from strandline.llm.runtime import stored, table
from strandline.session import ship

def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps.

    Null and empty texts are judged by the scorer like any other; repeated rows, and rows
    with one text, go or stay together; an empty table stays empty; all columns stay.
    """
    ship(spark)
    return quality.filter_quality(docs, quality.fit(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks and passages of lines that an earlier place has; n_chars follows, and a document left empty stays.

    Chunks are those of ``op3_line_chunks`` (rolling hash over line hashes, cuts at local
    minima, bytes compared); pairs of lines then take the passages that chunks leave.

    Null texts stay null; repeated rows are one document and stay alike; ties of a place go
    by key (null first), text hash and line; an empty table stays empty; all columns stay.
    """
    removed = "_" + max(docs.columns, key=len)  # a name that no column has
    out = line_dedup.dedup_passages(docs, removed=removed, chunks=True)
    return out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates (five words, 0.8).

    Rows are told apart by id and text: of several texts under one id each counts by itself,
    and of repeated rows one stays, as one does of rows with a null id, which come after
    all others.  Documents without words are in no group, so all of them stay; repeats of
    one such row are one.  An empty table stays empty; all columns stay.
    """
    ship(spark)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"))
    groups = stored(ngram_join.near_duplicate_components(docs.select(row.alias("row"), "text"), key="row"), "groups")
    marks = groups.groupBy("row").agg(F.count("*").alias("n"), F.max(F.col("row") != F.col("component_id")).alias("gone")).where("gone or n > 1")
    marks = marks.select(F.col("row.doc_id").alias("_id"), F.col("row.hash").alias("_hash"), "gone")
    same = docs["doc_id"].eqNullSafe(marks["_id"]) & (F.xxhash64(docs["text"]) == marks["_hash"])
    once = docs.join(marks, same, "left_anti")
    if marks.where("not gone").isEmpty():
        return once
    return once.unionByName(docs.join(marks.where("not gone"), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows go or stay together; an empty table, or an
    empty benchmark, changes nothing; all columns stay.
    """
    ship(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 2048 tokens.

    Null and empty texts have the closing id; repeated rows are packed as often as they
    occur; equal lengths go by a hash of key, piece and ids; an empty table gives no piece.
    """
    import public_tokenizers

    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: No SQL: the classifier, the edit matching and the tokenizer have none; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
