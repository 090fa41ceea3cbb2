"""Removes line chunks that repeat across a corpus, with DataFrame functions only.

A text's lines are hashed (the first 32 bits of MD5), a rolling hash runs over each
line's hash and the next one's, and a chunk begins at every local minimum of the
rolling hash: smaller than the one before and not larger than the one after.  Such
boundaries depend on four neighbouring lines at most, so a passage is cut alike
wherever it stands, and two boundaries are never adjacent.  Chunks of two or more lines
that occur again anywhere are removed after their bytes have been compared with those
of the first occurrence (by key, then by place), which stays.

Only hashes and places are shuffled for all chunks.  Texts are shuffled by key, once where
the table has no other columns (both joins then read one exchange), else once for each of
two joins; chunks whose hash repeats move once more, by hash and, where a hash has many
uses, a salt.

A chunk with one line (at a text's edges, or where a text has one line) is never
removed.  Null texts stay null, empty ones empty; whole texts are read.  Rows with the same
key and text are one document and are treated alike; of equal chunks the first place, by
key, then by a hash of the text, then by line, stays.  A null key is a key like any other
and comes first.  Extra columns stay; one named as ``removed`` is replaced.  If two
different chunks had one hash, those that differ from the first would stay whole.  An empty
table gives an empty result.

``dedup_line_chunks`` (whose result its SQL fixes) so leaves most passages of a few
lines, and a longer one's edges; ``dedup_passages`` takes these too, by pairs of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stored


def _with_chunks(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_c``: array<struct<at, n, body>> of a text's chunks.

    Each array is a column of its own: inside a lambda, an inlined array would be built
    again for every element.  Explode the result with ``explode_outer``: the filter that
    Spark infers from ``explode`` would be pushed down and inline them all.
    """
    line = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")
    least = lambda r, i: (i == 0) | ((r < F.get("_rolled", i - 1)) & (r <= F.get("_rolled", i + 1)))
    return (
        df.withColumn("_lines", F.split(F.col(text), "\n", -1))
        .withColumn("_hashes", F.transform("_lines", line))
        .withColumn("_rolled", F.transform("_hashes", lambda h, i: (h * 31 + F.coalesce(F.get("_hashes", i + 1), F.lit(0))) % F.lit(4294967291)))
        .withColumn("_starts", F.filter(F.transform("_rolled", lambda r, i: F.when(least(r, i), i)), lambda i: i.isNotNull()))
        .withColumn("_ends", F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(F.size("_lines"))))
        .withColumn("_c", F.transform("_starts", lambda a, i: F.struct(a.alias("at"), (F.get("_ends", i) - a).alias("n"), F.array_join(F.slice("_lines", a + 1, F.get("_ends", i) - a), "\n").alias("body"))))
        .drop("_lines", "_hashes", "_rolled", "_starts", "_ends")
    )


#: Uses of one hash that go to one task.
SHARE = 1000


def _keyed(df: DataFrame, key: str, text: str, removed: str) -> DataFrame:
    """Key, text and its hash as _ld_key, _ld_value and _ld_text, after all other columns but ``removed``."""
    others = [F.col(c) for c in df.columns if c not in (key, text, removed)]
    return df.select(*others, F.col(key).alias("_ld_key"), F.col(text).alias("_ld_value"), F.xxhash64(F.col(text)).alias("_ld_text"))


def _named(out: DataFrame, df: DataFrame, key: str, text: str, removed: str) -> DataFrame:
    """The columns of ``df`` in their order, then ``removed``."""
    names = {key: "_ld_key", text: "_ld_value"}
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in df.columns if c != removed), removed)


def _repeated(index: DataFrame, who: list[str]) -> DataFrame:
    """Rows of ``index`` (who, at, hash) whose hash occurs again, with ``kept`` (the first place) and ``salts``, and a ``salt`` below it."""
    again = index.groupBy("hash").agg(F.count("*").alias("uses"), F.min(F.struct(*who, "at")).alias("first")).where("uses > 1")
    marked = index.join(again, "hash").withColumn("kept", F.struct(*who, "at") == F.col("first")).withColumn("salts", (F.floor(F.col("uses") / SHARE) + 1).cast("int"))
    return marked.withColumn("salt", F.pmod(F.xxhash64(*who, "at"), F.col("salts")).cast("int")).drop("first", "uses")


def _places(repeated: DataFrame, who: list[str]) -> DataFrame:
    """The repeated places of each text, in one row."""
    each = F.struct(*(c for c in repeated.columns if c not in who))
    return repeated.groupBy(*who).agg(F.collect_list(each).alias("_ld_places")).select(F.col("_ld_key").alias("_ld_pk"), F.col("_ld_text").alias("_ld_pt"), "_ld_places")


def _same() -> Column:
    return F.col("_ld_key").eqNullSafe(F.col("_ld_pk")) & F.col("_ld_text").eqNullSafe(F.col("_ld_pt"))


def _later(found: DataFrame, who: list[str]) -> DataFrame:
    """Places of ``found`` (who, p, body) whose bytes are those of the first place of their hash.

    A hash with many uses is dealt to several tasks by salt, each with a copy of the first
    place's bytes; repeated rows of one document give one first place.
    """
    first = found.where("p.kept").select("p.hash", "p.salts", F.col("body").alias("first_body")).dropDuplicates(["hash"])
    dealt = first.select("hash", "first_body", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rest = found.where("not p.kept").select(*who, "p.at", *(["p.n"] if "n" in found.schema["p"].dataType.names else []), "p.hash", "p.salt", "body")
    return rest.join(dealt, ["hash", "salt"]).where(F.col("body") == F.col("first_body"))


def dedup_line_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "n_removed") -> DataFrame:
    """``df`` with repeated chunks taken out of ``text``; ``removed`` counts the lines taken out, and replaces a column of that name.

    Temporary columns are named with a leading ``_ld_``.
    """
    keyed = _keyed(df, key, text, removed)
    who = ["_ld_key", "_ld_text"]
    cut = _with_chunks(keyed.select(*who, "_ld_value"), "_ld_value").select(*who, F.explode_outer("_c").alias("_c")).where("_c.n > 1")
    index = stored(cut.select(*who, F.col("_c.at").alias("at"), F.col("_c.n").alias("n"), F.xxhash64("_c.body", F.reverse("_c.body")).alias("hash")).distinct(), "line-chunks")
    places = _places(_repeated(index, who), who)
    body = F.array_join(F.slice("_ld_lines", F.col("p.at") + 1, F.col("p.n")), "\n")
    split = keyed.join(places, _same()).withColumn("_ld_lines", F.split("_ld_value", "\n", -1))
    found = split.select(*who, "_ld_lines", F.explode("_ld_places").alias("p")).select(*who, "p", body.alias("body"))
    gone = _later(found, who).groupBy(*who).agg(F.collect_set(F.struct("at", "n")).alias("_ld_gone")).select(F.col("_ld_key").alias("_ld_pk"), F.col("_ld_text").alias("_ld_pt"), "_ld_gone")
    joined = keyed.join(gone, _same(), "left")
    left = F.filter(F.split("_ld_value", "\n", -1), lambda _, i: ~F.exists("_ld_gone", lambda g: (i >= g["at"]) & (i < g["at"] + g["n"])))
    count = F.coalesce(F.aggregate("_ld_gone", F.lit(0), lambda a, g: a + g["n"]), F.lit(0)).cast("long")
    out = joined.withColumn("_ld_value", F.when(F.col("_ld_gone").isNull(), F.col("_ld_value")).otherwise(F.array_join(left, "\n"))).withColumn(removed, count)
    return _named(out, df, key, text, removed)


def _with_pairs(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_c``: array<struct<at, hash>> of a text's pairs of neighbouring lines, but those of blank lines."""
    blank = lambda i: F.trim(F.get("_lines", i)) == ""
    pair = lambda h, i: F.when((i + 1 < F.size("_hashes")) & ~(blank(i) & blank(i + 1)), F.struct(i.alias("at"), F.xxhash64(h, F.get("_hashes", i + 1)).alias("hash")))
    return (
        df.withColumn("_lines", F.split(F.col(text), "\n", -1))
        .withColumn("_hashes", F.transform("_lines", lambda x: F.xxhash64(x)))
        .withColumn("_c", F.filter(F.transform("_hashes", pair), lambda p: p.isNotNull()))
        .drop("_lines", "_hashes")
    )


def dedup_passages(df: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "n_removed", chunks: bool = False) -> DataFrame:
    """``df`` without repeated passages of two or more lines; ``removed`` counts the lines taken out.

    A line goes where it and a neighbour stand, byte for byte, at an earlier place (by key,
    then by line); runs of such pairs are whole passages, edges included, wherever chunks
    are cut.  It takes all that ``dedup_line_chunks`` takes but chunks of blank lines.  A
    line's first place in the corpus always stays, and single lines are never removed.
    With ``chunks``, the chunks of ``dedup_line_chunks`` are found and compared as there, in
    the same shuffles, and pairs take what chunks leave: repeated chunks of blank lines go too.
    """
    keyed = _keyed(df, key, text, removed)
    who = ["_ld_key", "_ld_text"]
    cut = _with_pairs(keyed.select(*who, "_ld_value"), "_ld_value").select(*who, F.explode_outer("_c").alias("_c")).where("_c.at IS NOT NULL")
    found = cut.select(*who, "_c.at", F.lit(2).alias("n"), "_c.hash")
    if chunks:
        whole = _with_chunks(keyed.select(*who, "_ld_value"), "_ld_value").select(*who, F.explode_outer("_c").alias("_c")).where("_c.n > 1")
        found = found.unionByName(whole.select(*who, "_c.at", "_c.n", F.xxhash64("_c.body", F.reverse("_c.body")).alias("hash")))
    index = stored(found.distinct(), "line-pairs")
    places = _places(_repeated(index, who), who)
    body = F.array_join(F.slice("_ld_lines", F.col("p.at") + 1, F.col("p.n")), "\n")
    split = keyed.join(places, _same()).withColumn("_ld_lines", F.split("_ld_value", "\n", -1))
    found = split.select(*who, "_ld_lines", F.explode("_ld_places").alias("p")).select(*who, "p", body.alias("body"))
    gone = _later(found, who).groupBy(*who).agg(F.collect_set(F.struct("at", "n")).alias("_ld_gone")).select(F.col("_ld_key").alias("_ld_pk"), F.col("_ld_text").alias("_ld_pt"), "_ld_gone")
    # array_except looks places up in a hash set, so a text costs time in proportion to its lines.
    joined = keyed.join(gone, _same(), "left").withColumn("_ld_lines", F.split("_ld_value", "\n", -1))
    lines = F.flatten(F.transform("_ld_gone", lambda g: F.sequence(g["at"], g["at"] + g["n"] - 1)))
    joined = joined.withColumn("_ld_stay", F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), lines))
    left = F.array_join(F.transform("_ld_stay", lambda i: F.get("_ld_lines", i)), "\n")
    count = F.when(F.col("_ld_gone").isNull(), 0).otherwise(F.size("_ld_lines") - F.size("_ld_stay")).cast("long")
    out = joined.withColumn(removed, count).withColumn("_ld_value", F.when(F.col("_ld_gone").isNull(), F.col("_ld_value")).otherwise(left))
    return _named(out, df, key, text, removed)


#: DuckDB SQL of the same as ``dedup_line_chunks``, for (doc_id, text, n_removed).
SQL = r"""
WITH lines AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM {documents}),
hashed AS (SELECT *, CAST(('0x' || md5(line)[1:8]) AS BIGINT) AS h FROM lines),
rolled AS (SELECT *, (h * 31 + coalesce(lead(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4294967291 AS r FROM hashed),
marked AS (SELECT *, i = 0 OR coalesce(r < lag(r) OVER w AND r <= lead(r) OVER w, false) AS s FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM marked),
chunks AS (SELECT doc_id, c, min(i) AS pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, c),
gone AS (SELECT doc_id, c FROM (SELECT doc_id, c, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS k FROM chunks WHERE n > 1) WHERE k > 1),
result AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.c IS NULL) AS left_text, count(g.c) AS n_removed
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.c = n.c GROUP BY n.doc_id)
"""
