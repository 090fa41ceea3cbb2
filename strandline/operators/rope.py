"""Sequences as ropes: rows (keys, chunk, piece) of ``WIDTH`` symbols, edited where they lie.

An edit exchanges ``len`` symbols at ``start`` for ``str_value``.  It is dealt to the chunks
that it touches, each chunk is rebuilt by itself, and only then may pieces be joined: the
work of an edit is bounded by a chunk's width and not by the sequence, and a sequence need
not fit into one row.  After edits a piece has any length; its chunk number still gives
its order, and lengths before it come from running sums over chunks.

An empty sequence has one empty piece.  Edits of a sequence are disjoint; an insertion
where an exchange begins goes before it.  Edits of keys that the rope does not have are
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import totals_before

WIDTH = 1000


def to_rope(rows: DataFrame, keys: tuple[str, ...], width: int = WIDTH, seq: str = "seq") -> DataFrame:
    """keys, chunk, piece of rows (keys, seq)."""
    parts = F.regexp_extract_all(seq, F.lit("(?s).{1,%d}" % width), F.lit(0))
    return rows.select(*keys, F.posexplode(F.when(F.length(seq) == 0, F.array(F.lit(""))).otherwise(parts)).alias("chunk", "piece")).withColumn("chunk", F.col("chunk").cast("long"))


def from_rope(rope: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, seq: pieces joined in order; only for sequences that fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "piece")))
    return rope.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("seq"))


def _dealt(edits: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """Edits cut at the borders of chunks: keys, chunk, at (in the chunk), n, str_value.

    What stands between two chunks is put at the end of the first.  What an edit puts in is
    put where it begins, or where it exchanges symbols one for one, each in its place.
    """
    start, stop = F.col("start").cast("long"), (F.col("start") + F.col("len")).cast("long")
    first = F.when(F.col("len") == 0, F.greatest(start - 1, F.lit(0))).otherwise(start)
    chunks = F.sequence(F.floor(first / width), F.floor(F.greatest(stop - 1, first) / width))
    each = edits.select(*keys, start.alias("_start"), "len", stop.alias("_stop"), F.floor(first / width).alias("_first"), "str_value", F.explode(chunks).alias("chunk"))
    low = F.greatest(F.col("_start") - F.col("chunk") * width, F.lit(0))
    high = F.least(F.col("_stop") - F.col("chunk") * width, F.lit(width))
    n = F.greatest(high - low, F.lit(0))
    own = F.substring("str_value", (F.col("chunk") * width + low - F.col("_start") + 1).cast("int"), n.cast("int"))
    value = F.when(F.length("str_value") == F.col("len"), own).when(F.col("chunk") == F.col("_first"), F.col("str_value")).otherwise("")
    return each.select(*keys, "chunk", low.alias("at"), n.alias("n"), value.alias("str_value"))


def _rebuilt(piece: Column, edits: Column) -> Column:
    """A piece with sorted edits (at, n, str_value): what lies between them and what they put in."""
    end = lambda i: F.when(i > 0, F.get(edits, i - 1)["at"] + F.get(edits, i - 1)["n"]).otherwise(0)
    parts = F.transform(edits, lambda e, i: F.concat(F.substring(piece, (end(i) + 1).cast("int"), (e["at"] - end(i)).cast("int")), e["str_value"]))
    last = F.element_at(edits, -1)
    return F.concat(F.array_join(parts, ""), F.substring(piece, (last["at"] + last["n"] + 1).cast("int"), F.length(piece)))


def edited(rope: DataFrame, edits: DataFrame, keys: tuple[str, ...], width: int = WIDTH) -> DataFrame:
    """keys, chunk, piece: a rope of chunks of ``width`` symbols with edits (keys, start, len, str_value)."""
    own = _dealt(edits, keys, width).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "n", "str_value"))).alias("_e"))
    piece = F.when(F.col("_e").isNull(), F.col("piece")).otherwise(_rebuilt(F.col("piece"), F.col("_e")))
    return rope.select(*keys, "chunk", "piece").join(own, [*keys, "chunk"], "left").select(*keys, "chunk", piece.alias("piece"))


def placed(rope: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds ``offset``: how many symbols stand before each piece."""
    sizes = rope.select(*keys, "chunk", F.length("piece").cast("long").alias("offset"))
    return rope.join(totals_before(sizes, [*keys], "chunk", ["offset"]), [*keys, "chunk"])


def evened(rope: DataFrame, keys: tuple[str, ...], width: int = WIDTH) -> DataFrame:
    """keys, chunk, piece: the same sequences in chunks of ``width`` symbols again; an empty one keeps one empty piece."""
    cut = placed(rope, keys).withColumn("_stop", F.col("offset") + F.length("piece"))
    inside = F.sequence(F.floor(F.col("offset") / width), F.floor(F.greatest(F.col("_stop") - 1, F.col("offset")) / width))
    each = cut.select(*keys, "piece", "offset", "_stop", F.explode(inside).alias("_to"))
    low = F.greatest(F.col("_to") * width, F.col("offset"))
    high = F.least((F.col("_to") + 1) * width, F.col("_stop"))
    parts = each.select(*keys, "_to", low.alias("_low"), F.substring("piece", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("s"), (F.col("_stop") == F.col("offset")).alias("_none"))
    joined = parts.groupBy(*keys, F.col("_to").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_low", "s"))), lambda p: p["s"]), "").alias("piece"))
    return joined.where((F.col("piece") != "") | (F.col("chunk") == 0))


def wrapped(rope: DataFrame, names: DataFrame, keys: tuple[str, ...], width: int, lines: int = 50) -> DataFrame:
    """keys, chunk, text: FASTA lines of ``width`` symbols, ``lines`` of them in a row of text; chunk -1 is the header.

    ``names`` has keys and name.  No sequence is joined: a chunk of whole lines is wrapped by itself.
    """
    body = evened(rope, keys, width * lines).where("piece <> ''")
    text = F.regexp_replace("piece", "(.{%d})(?!$)" % width, "$1\n")
    head = names.select(*keys, F.lit(-1).cast("long").alias("chunk"), F.concat(F.lit(">"), F.col("name")).alias("text"))
    return head.unionByName(body.select(*keys, "chunk", text.alias("text")))
