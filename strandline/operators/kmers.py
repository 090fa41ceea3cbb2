"""k-mer tables, shared k-mers and exact-match seeds.

The sequences of a reference meet as strings and are compared in numpy; queries of all
references, and references too large for a task, meet by a join on k-mers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..storage import stored
from . import longest, matching
from .matching import MOST_K, letters_of, set_sizes, shared_counts, shared_hits, split_by_letters, without_code

CHUNK = 64


def kmers(seqs: DataFrame, k: int, *keys: str, every: int = 1) -> DataFrame:
    """keys, pos, kmer; sequences shorter than k have none.

    Sequences are cut once into short chunks, each with the first letters of the next:
    a place inside a string is found by walking to it, so k-mers are cut from chunks.
    """
    step = max(CHUNK, k - 1)
    step += -step % every
    parts = F.regexp_extract_all("seq", F.lit("(?s).{1,%d}" % step), F.lit(0))
    cut = seqs.where(F.length("seq") >= k).select(*keys, parts.alias("_p"))
    chunks = F.transform("_p", lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("_p", i + 1), 1, k - 1), F.lit(""))))
    rows = cut.select(*keys, F.posexplode(chunks).alias("_c", "_s")).where(F.length("_s") >= k)
    inside = F.transform(F.sequence(F.lit(0), F.length("_s") - k, F.lit(every)), lambda i: F.substring("_s", i + 1, F.lit(k)))
    return rows.select(*keys, "_c", F.posexplode(inside).alias("_i", "kmer")).select(*keys, (F.col("_c").cast("long") * step + F.col("_i") * every).alias("pos"), "kmer")


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, n, n_seqs: counted for each sequence first, so that distinct counting needs no second pass over k-mers."""
    own = kmers(seqs, k, "seq_idx").groupBy("kmer", "seq_idx").agg(F.count("*").alias("c"))
    return own.groupBy("kmer").agg(F.sum("c").alias("n"), F.count("*").alias("n_seqs"))


def shared_kmers(aln: DataFrame, k: int, centre: int = 0) -> DataFrame:
    """aln_id, row_idx, n_kmers, n_shared: a row's k-mers that the centre has, exactly.

    The rows of an alignment meet as strings (:mod:`matching`); long k-mers and alignments
    with letters that have no code are joined by k-mer.
    """
    ungapped = aln.select("aln_id", "row_idx", F.replace("seq", F.lit("-"), F.lit("")).alias("seq"))
    if k > MOST_K:
        return _joined_shared(ungapped, k, centre)
    rows = ungapped.select(F.col("aln_id").alias("ref_idx"), F.col("row_idx").alias("query_idx"), "seq")
    odd, large = letters_of(rows)
    found = shared_counts(rows if odd is None else rows.join(odd, "ref_idx", "left_anti"), k, centre, large)
    counted = found.groupBy(F.col("ref_idx").alias("aln_id"), F.col("query_idx").alias("row_idx")).agg(F.sum("n").alias("n_kmers"), F.sum("shared").alias("n_shared"))
    return counted if odd is None else counted.unionByName(_joined_shared(ungapped.join(odd.withColumnRenamed("ref_idx", "aln_id"), "aln_id", "left_semi"), k, centre))


def _joined_shared(ungapped: DataFrame, k: int, centre: int) -> DataFrame:
    known = kmers(ungapped.where(F.col("row_idx") == centre), k, "aln_id").select("aln_id", "kmer", F.lit(1).alias("hit")).distinct()
    return kmers(ungapped, k, "aln_id", "row_idx").join(known, ["aln_id", "kmer"], "left").groupBy("aln_id", "row_idx").agg(F.count("*").alias("n_kmers"), F.count("hit").alias("n_shared"))


def _joined_similarity(aln: DataFrame, k: int, centre: int = 0) -> DataFrame:
    """aln_id, row_idx, similarity: Jaccard similarity of a row's k-mers and the centre's, by a join of k-mers."""
    ungapped = aln.withColumn("seq", F.replace("seq", F.lit("-"), F.lit("")))
    own = stored(kmers(ungapped, k, "aln_id", "row_idx").select("aln_id", "row_idx", "kmer").distinct(), "kmer-sets")
    mid = own.where(F.col("row_idx") == centre).select("aln_id", "kmer", F.lit(1).alias("_hit"))
    counted = own.join(mid, ["aln_id", "kmer"], "left").groupBy("aln_id", "row_idx").agg(F.count("*").alias("_n"), F.count("_hit").alias("_shared"))
    sizes = counted.where(F.col("row_idx") == centre).select("aln_id", F.col("_n").alias("_m"))
    return counted.join(sizes, "aln_id").select("aln_id", "row_idx", (F.col("_shared").cast("double") / (F.col("_n") + F.col("_m") - F.col("_shared"))).alias("similarity"))


def _sketched_similarity(aln: DataFrame, k: int, centre: int = 0) -> DataFrame:
    """aln_id, row_idx, similarity: Jaccard similarity of k-mer sets from theta sketches."""
    ungapped = aln.withColumn("seq", F.replace("seq", F.lit("-"), F.lit("")))
    sketches = kmers(ungapped, k, "aln_id", "row_idx").groupBy("aln_id", "row_idx").agg(F.expr("theta_sketch_agg(kmer)").alias("s"))
    mid = sketches.where(F.col("row_idx") == centre).select("aln_id", F.col("s").alias("c"))
    share = F.expr("theta_sketch_estimate(theta_intersection(s, c)) / theta_sketch_estimate(theta_union(s, c))")
    return sketches.join(mid, "aln_id").select("aln_id", "row_idx", share.cast("double").alias("similarity"))


def similarities(aln: DataFrame, k: int, centre: int = 0) -> DataFrame:
    """aln_id, row_idx, similarity, estimate: :func:`exact_similarity` and :func:`approximate_similarity` in one pass; the rows of an alignment meet as strings (:mod:`matching`).

    Long k-mers and alignments with letters that have no code are joined by k-mer.
    """
    ungapped = aln.select("aln_id", "row_idx", F.replace("seq", F.lit("-"), F.lit("")).alias("seq"))
    by_join = lambda rows: _joined_similarity(rows, k, centre).join(_sketched_similarity(rows, k, centre).withColumnRenamed("similarity", "estimate"), ["aln_id", "row_idx"])
    if k > MOST_K:
        return by_join(ungapped)
    odd = without_code(ungapped.select(F.col("aln_id").alias("ref_idx"), "seq"))
    rows = ungapped if odd is None else ungapped.join(odd.withColumnRenamed("ref_idx", "aln_id"), "aln_id", "left_anti")
    found = set_sizes(rows.select(F.col("aln_id").alias("ref_idx"), F.col("row_idx").alias("query_idx"), "seq"), k, centre)
    counted = found.groupBy(F.col("ref_idx").alias("aln_id"), F.col("query_idx").alias("row_idx")).agg(*(F.sum(c).alias(c) for c in ("n", "shared", "estimate")))
    sizes = counted.where(F.col("row_idx") == centre).select("aln_id", F.col("n").alias("_m"))
    either = F.col("n") + F.col("_m") - F.col("shared")
    known = counted.join(sizes, "aln_id").select("aln_id", "row_idx", (F.col("shared").cast("double") / either).alias("similarity"), (F.col("estimate") / either).alias("estimate"))
    return known if odd is None else known.unionByName(by_join(ungapped.join(odd.withColumnRenamed("ref_idx", "aln_id"), "aln_id", "left_semi")))


def exact_similarity(aln: DataFrame, k: int, centre: int = 0) -> DataFrame:
    """aln_id, row_idx, similarity: Jaccard similarity of a row's k-mers and the centre's; rows without k-mers are left out."""
    return similarities(aln, k, centre).drop("estimate")


def approximate_similarity(aln: DataFrame, k: int, centre: int = 0) -> DataFrame:
    """aln_id, row_idx, similarity: Jaccard similarity of k-mer sets estimated on their least hashes (comparative only)."""
    return similarities(aln, k, centre).select("aln_id", "row_idx", F.col("estimate").alias("similarity"))


def unique_hits(queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """ref_idx, ref_pos, query_idx, query_pos of k-mers that the reference has exactly once; queries are cut every k bases."""
    once = kmers(reference, k, "ref_idx").groupBy("ref_idx", "kmer").agg(F.count("*").alias("n"), F.min("pos").alias("ref_pos")).where("n = 1")
    cut = kmers(queries, k, "ref_idx", "query_idx", every=k).withColumnRenamed("pos", "query_pos")
    return cut.join(once, ["ref_idx", "kmer"]).select("ref_idx", "ref_pos", "query_idx", "query_pos")



def _joined_hits(queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    index = kmers(reference, k, "ref_idx").withColumnRenamed("pos", "ref_pos")
    known = [c for c in ("ref_idx", "query_idx") if c in queries.columns]
    found = kmers(queries, k, *known).withColumnRenamed("pos", "query_pos").join(index, [*(c for c in known if c == "ref_idx"), "kmer"])
    return found.select("ref_idx", "query_idx", "query_pos", "ref_pos")


def kmer_hits(queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """ref_idx, query_idx, query_pos, ref_pos: where a query's k-mer is a reference's.

    Queries with a ref_idx meet their reference as strings (:mod:`matching`); others, long
    k-mers and references with letters beyond A, C, G, T, N and the gap are joined by k-mer.
    """
    if "ref_idx" not in queries.columns or k > MOST_K:
        return _joined_hits(queries, reference, k)
    odd = split_by_letters(queries, reference)
    if odd is None:
        return shared_hits(queries, reference, k)
    of = lambda rows, how: rows.join(odd, "ref_idx", how)
    return shared_hits(of(queries, "left_anti"), of(reference, "left_anti"), k).unionByName(_joined_hits(of(queries, "left_semi"), of(reference, "left_semi"), k))


def _with_reference(queries: DataFrame, reference: DataFrame | None) -> DataFrame:
    """ref_idx, query_idx, own, seq: queries and their references' own sequences."""
    if reference is None:
        return queries.select("ref_idx", "query_idx", "own", "seq")
    own = reference.select("ref_idx", F.lit(None).cast(queries.schema["query_idx"].dataType).alias("query_idx"), F.lit(True).alias("own"), "seq")
    return queries.select("ref_idx", "query_idx", F.lit(False).alias("own"), "seq").unionByName(own)


def _by_size(queries: DataFrame, reference: DataFrame | None, near: Callable[[DataFrame], DataFrame], far: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``near`` of references whose sequences have up to ``SHARE`` letters together, which one task holds, and ``far`` of the others.

    Queries without a ref_idx are searched on all references by ``far``; those with ``own``
    hold their references' sequences themselves, and ``reference`` is None.
    """
    if "ref_idx" not in queries.columns:
        return far(queries, reference)
    rows = _with_reference(queries, reference)
    large = rows.groupBy("ref_idx").agg(F.sum(F.length("seq")).alias("_total")).where(F.col("_total") > matching.SHARE).select("ref_idx")
    if large.isEmpty():
        return near(rows)
    rest = rows.join(large, "ref_idx", "left_semi")
    return near(rows.join(large, "ref_idx", "left_anti")).unionByName(far(rest.where("not own").drop("own"), rest.where("own").select("ref_idx", "seq")))


def longest_matches(queries: DataFrame, reference: DataFrame | None, least: int) -> DataFrame:
    """ref_idx, query_idx, query_pos, length, ref_pos: the longest exact match from each place of a query, a row for each of its places.

    Queries with a ref_idx are compared with that reference (:mod:`longest`), others with all;
    they may come with their reference's own sequences, marked by ``own``.
    """
    return _by_size(queries, reference, lambda rows: longest.inside(rows, least), lambda q, r: _matches_by_hits(q, r, least))


def _matches_by_hits(queries: DataFrame, reference: DataFrame, least: int) -> DataFrame:
    """The longest matches from hits of k-mers.

    Neighbouring hits on one diagonal are one match: a hit's length follows from the end of
    its island, without comparing bases.
    """
    hits = kmer_hits(queries, reference, least)
    diagonal = ["ref_idx", "query_idx", F.col("ref_pos") - F.col("query_pos")]
    island = F.col("query_pos") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("query_pos"))
    grown = hits.withColumn("island", island).withColumn("length", (F.max("query_pos").over(Window.partitionBy(*diagonal, "island")) - F.col("query_pos") + least).cast("long"))
    best = Window.partitionBy("ref_idx", "query_idx", "query_pos")
    return grown.withColumn("most", F.max("length").over(best)).where("length = most").select("ref_idx", "query_idx", "query_pos", "length", "ref_pos")


def prefix_matches(queries: DataFrame, reference: DataFrame | None, least: int) -> DataFrame:
    """ref_idx, query_idx, query_pos, length, ref_positions: the longest match from each place, with all its places in one row."""
    listed = lambda found: found.groupBy("ref_idx", "query_idx", "query_pos").agg(F.max("length").alias("length"), F.array_sort(F.collect_list("ref_pos")).alias("ref_positions"))
    return _by_size(queries, reference, lambda rows: longest.inside(rows, least, listed=True), lambda q, r: listed(_matches_by_hits(q, r, least)))


def walked(places: DataFrame, keys: list[str]) -> DataFrame:
    """keys, query_pos of the places (keys, query_pos, length) that a walk takes: the first one, then the first one behind it, and so on.

    Each place points to the first at or behind its end.  Pointers are doubled, and what the
    walk reaches doubles with them, so a walk of n places needs about log2(n) joins and no
    query is gathered in a row.
    """
    end = F.col("query_pos") + F.col("length")
    none = F.lit(None).cast("long")
    marks = places.select(*keys, F.col("query_pos").alias("_at"), F.lit(0).alias("_kind"), F.col("query_pos").alias("to"), none.alias("query_pos"))
    asks = places.select(*keys, end.alias("_at"), F.lit(1).alias("_kind"), none.alias("to"), "query_pos")
    behind = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    jump = marks.unionByName(asks).withColumn("to", F.last("to", ignorenulls=True).over(behind)).where("_kind = 1 and to is not null").select(*keys, "query_pos", "to")
    jump = stored(jump, "jumps")
    reached = places.groupBy(*keys).agg(F.min("query_pos").alias("query_pos"))
    while not jump.isEmpty():
        reached = stored(reached.unionByName(reached.join(jump, [*keys, "query_pos"]).select(*keys, F.col("to").alias("query_pos"))), "reached")
        further = jump.select(*keys, F.col("query_pos").alias("to"), F.col("to").alias("_far"))
        jump = stored(jump.join(further, [*keys, "to"]).select(*keys, "query_pos", F.col("_far").alias("to")), "jumps")
    return reached


def greedy_seeds(queries: DataFrame, reference: DataFrame | None, least: int = 15, unique: bool = False) -> DataFrame:
    """ref_idx, query_idx, ref_pos, query_pos, length: from the left, the longest match at a place, then on behind it.

    With ``unique``, places whose longest match occurs several times are stepped over.
    """
    near = lambda rows: longest.inside(rows, least, walk=True, unique=unique)
    return _by_size(queries, reference, near, lambda q, r: _seeds_by_hits(q, r, least, unique)).select("ref_idx", "query_idx", "ref_pos", "query_pos", "length")


def _seeds_by_hits(queries: DataFrame, reference: DataFrame, least: int, unique: bool) -> DataFrame:
    found = stored(_matches_by_hits(queries, reference, least), "matches")
    places = found.groupBy("ref_idx", "query_idx", "query_pos").agg(F.max("length").alias("length"), F.count("*").alias("n"))
    if unique:
        places = places.where("n = 1")
    taken = walked(stored(places, "places"), ["ref_idx", "query_idx"])
    return found.join(taken, ["ref_idx", "query_idx", "query_pos"]).select("ref_idx", "query_idx", "query_pos", "length", "ref_pos")


def map_reads(reads: DataFrame, references: DataFrame, least: int = 15, unique: bool = False) -> DataFrame:
    """read_idx, strand, ref_idx, ref_pos, query_pos, length: greedy seeds of reads (read_idx, seq) on all references (ref_idx, seq).

    A read is searched as it is (strand +) and as its reverse complement (strand -), whose
    own coordinates query_pos then counts.
    """
    forward = reads.select("read_idx", F.lit("+").alias("strand"), "seq")
    both = forward.unionByName(reads.select("read_idx", F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))
    seeds = greedy_seeds(both.select(F.struct("read_idx", "strand").alias("query_idx"), "seq"), references, least, unique)
    return seeds.select("query_idx.read_idx", "query_idx.strand", "ref_idx", "ref_pos", "query_pos", "length")
