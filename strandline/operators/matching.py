"""k-mers of sequences that meet inside one reference, compared in numpy without a row a k-mer.

The sequences of a reference (its own and its queries') go to one task as strings, many
references at a time.  Where they have more than ``SHARE`` letters together, their k-mers are
dealt by code to several shares, so a task holds a bounded number of them whatever a
sequence's length.  Codes have three bits a letter and are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship

#: Letters, and letters of a reference's sequences that one task holds.
LETTERS, SHARE = "ACGTN-", 1 << 22
#: The longest k whose codes fit, and the letters of a piece.
MOST_K, PIECE = 20, 1 << 16
#: Letters that are compared at once (several small references), and hits that are given at once.
TOGETHER, GIVEN = 1 << 20, 1 << 17

#: Least hashes of two sets that an estimate of their similarity looks at.
SKETCH = 1 << 12

_CODES = np.zeros(256, np.int64)
_CODES[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)


def codes(text: str, k: int) -> np.ndarray:
    """The code of the k-mer at each place."""
    letters = _CODES[np.frombuffer(text.encode("ascii"), np.uint8)]
    out = np.zeros(max(len(letters) - k + 1, 0), np.int64)
    for i in range(k):
        out = (out << 3) | letters[i : i + len(out)]
    return out


def _pieces(rows: DataFrame, k: int, large: bool = True) -> DataFrame:
    """ref_idx, query_idx, base, piece, shares of rows (ref_idx, query_idx, seq): pieces have the first letters of the next.

    Unless some reference is ``large``, none is dealt to shares, and rows need not meet their reference's size.
    """
    parts = F.regexp_extract_all("seq", F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    sized, shares = rows.where(F.length("seq") >= k), F.lit(1).cast("long")
    if large:
        total = rows.groupBy("ref_idx").agg(F.sum(F.length("seq")).alias("_total"))
        sized, shares = sized.join(total, "ref_idx", "left"), F.coalesce(F.ceil(F.col("_total") / SHARE).cast("long"), F.lit(1).cast("long"))  # a null meets none
    cut = sized.select("ref_idx", "query_idx", shares.alias("shares"), parts.alias("_p"))
    pieces = F.transform("_p", lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("_p", i + 1), 1, k - 1), F.lit(""))))
    each = cut.select("ref_idx", "query_idx", "shares", F.posexplode(pieces).alias("_c", "piece")).where(F.length("piece") >= k)
    return each.select("ref_idx", "query_idx", (F.col("_c").cast("long") * PIECE).alias("base"), "piece", "shares")


def _dealt(pieces: DataFrame, k: int, large: bool = True) -> DataFrame:
    """ref_idx, query_idx, base, piece, share, at, code: pieces of small references as they are, others as places and codes by share."""
    kind = pieces.select("ref_idx", "query_idx", "base", "piece", F.lit(0).cast("long").alias("share"), F.col("piece").cast("binary").alias("at"), F.col("piece").cast("binary").alias("code")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        for batch in batches:
            for row, (base, text, shares) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                code = codes(text, k)
                of = (code * 0x9E3779B1 >> 20) % shares
                order = np.argsort(of, kind="stable")
                found, begins = np.unique(of[order], return_index=True)
                parts = np.split(order, begins[1:])
                ids = [batch.column(c).take(pa.array([row] * len(found))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array([base] * len(found), pa.int64()), pa.nulls(len(found), pa.string()), pa.array(found, pa.int64()), pa.array([p.astype(np.int64).tobytes() for p in parts]), pa.array([code[p].tobytes() for p in parts])], schema=names)

    none = [F.lit(None).cast("binary").alias(c) for c in ("at", "code")]
    if not large:
        return pieces.select("ref_idx", "query_idx", "base", "piece", F.lit(0).cast("long").alias("share"), *none)
    small = pieces.where("shares <= 1").select("ref_idx", "query_idx", "base", "piece", F.lit(0).cast("long").alias("share"), *none)
    return small.unionByName(pieces.where("shares > 1").mapInArrow(run, kind))


def compared(rows: DataFrame, k: int, kind: StructType, made: Callable[..., Iterator[pa.RecordBatch]], large: bool = True) -> DataFrame:
    """What ``made`` gives for the k-mers of some whole references (or shares, where some reference is ``large``) at a time.

    ``rows`` has ref_idx, query_idx (null for the reference's own sequence) and seq.
    ``made`` gets the arrays group, code, row and pos of k-mers, and the lists of ref_idx and query_idx by row.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, groups, size, held = None, -1, 0, []
        for batch in batches:
            for ref, query, base, piece, share, place, code in zip(*(c.to_pylist() for c in batch.columns)):
                if (ref, share) != at:
                    if size > TOGETHER:
                        yield from _given(held, made)
                        groups, size, held = -1, 0, []
                    at, groups = (ref, share), groups + 1
                own = codes(piece, k) if piece is not None else np.frombuffer(code, np.int64)
                pos = base + (np.arange(len(own)) if piece is not None else np.frombuffer(place, np.int64))
                held.append((groups, ref, query, own, pos))
                size += len(own)
        if held:
            yield from _given(held, made)

    dealt = _dealt(_pieces(rows, k, large), k, large).repartition("ref_idx", "share").sortWithinPartitions("ref_idx", "share")
    return dealt.select("ref_idx", "query_idx", "base", "piece", "share", "at", "code").mapInArrow(run, kind)


def _given(held: list, made: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    sizes = [len(h[3]) for h in held]
    group = np.repeat([h[0] for h in held], sizes)
    yield from made(group, np.concatenate([h[3] for h in held]), np.repeat(np.arange(len(held)), sizes), np.concatenate([h[4] for h in held]), [h[1] for h in held], [h[2] for h in held])


def shared_hits(queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """ref_idx, query_idx, query_pos, ref_pos: places of equal k-mers in queries (ref_idx, query_idx, seq) and their reference (ref_idx, seq)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = queries.select("ref_idx", "query_idx", "seq").unionByName(reference.select("ref_idx", F.lit(None).cast(queries.schema["query_idx"].dataType).alias("query_idx"), "seq"))
    kind = queries.select("ref_idx", "query_idx", F.lit(0).cast("long").alias("query_pos"), F.lit(0).cast("long").alias("ref_pos")).schema

    def made(group, code, row, pos, refs, queries_) -> Iterator[pa.RecordBatch]:
        names = to_arrow_schema(kind)
        ref_of, query_of = pa.array(refs, names.field(0).type), pa.array(queries_, names.field(1).type)
        own = np.array([q is None for q in queries_])[row]
        _, rank = np.unique(code, return_inverse=True)
        key = group * (int(rank.max(initial=0)) + 1) + rank
        mine, asked = np.flatnonzero(own), np.flatnonzero(~own)
        mine = mine[np.argsort(key[mine], kind="stable")]
        first, last = (np.searchsorted(key[mine], key[asked], side=s) for s in ("left", "right"))
        asked, first, n = asked[last > first], first[last > first], (last - first)[last > first]
        part = np.cumsum(n) // GIVEN
        for few in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(part)) + 1):
            if not len(few):
                continue
            q = np.repeat(asked[few], n[few])
            r = mine[np.repeat(first[few] - (np.cumsum(n[few]) - n[few]), n[few]) + np.arange(len(q))]
            at = pa.array(row[q])
            yield pa.RecordBatch.from_arrays([ref_of.take(at), query_of.take(at), pa.array(pos[q]), pa.array(pos[r])], schema=names)

    return compared(rows, k, kind, made)


def _mixed(code: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each code, another for each."""
    x = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _share_of(own: np.ndarray, others: np.ndarray, both: np.ndarray) -> float:
    """How many codes of either set are in both, estimated on the ``SKETCH`` of least hashes; exact where there are no more."""
    more = np.setdiff1d(others, own[both], assume_unique=True)
    n = len(own) + len(more)
    if n <= SKETCH:
        return float(both.sum())
    least = np.argpartition(_mixed(np.concatenate([own, more])), SKETCH)[:SKETCH]
    return float(both[least[least < len(own)]].sum()) * n / SKETCH


def set_sizes(rows: DataFrame, k: int, centre: int) -> DataFrame:
    """ref_idx, query_idx, n, shared, estimate: distinct k-mers of each sequence (ref_idx, query_idx, seq), those that ``centre`` has too, and their estimate, by share."""
    from pyspark.sql.pandas.types import to_arrow_schema

    zero = F.lit(0).cast("long")
    kind = rows.select("ref_idx", "query_idx", zero.alias("n"), zero.alias("shared"), F.lit(0.0).alias("estimate")).schema

    def made(group, code, row, pos, refs, queries) -> Iterator[pa.RecordBatch]:
        found, begins = [], np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(begins, [*begins[1:], len(group)]):
            pieces = np.flatnonzero(np.diff(row[lo:hi], prepend=-1))
            own: dict[object, list[np.ndarray]] = {}
            for r, part in zip(row[lo:hi][pieces], np.split(code[lo:hi], pieces[1:])):
                own.setdefault(queries[r], []).append(part)
            sets = {q: np.unique(np.concatenate(parts)) for q, parts in own.items()}
            mid = sets.get(centre, code[:0])
            for q, codes_ in sets.items():
                both = np.isin(codes_, mid, assume_unique=True)
                found.append((refs[row[lo]], q, len(codes_), int(both.sum()), _share_of(codes_, mid, both)))
        names = to_arrow_schema(kind)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), names)], schema=names)

    return compared(rows, k, kind, made)


def shared_counts(rows: DataFrame, k: int, centre: int, large: bool) -> DataFrame:
    """ref_idx, query_idx, n, shared: k-mers of each sequence (ref_idx, query_idx, seq), repeats counted, and those that ``centre`` has, by piece and share."""
    from pyspark.sql.pandas.types import to_arrow_schema

    zero = F.lit(0).cast("long")
    kind = rows.select("ref_idx", "query_idx", zero.alias("n"), zero.alias("shared")).schema

    def made(group, code, row, pos, refs, queries) -> Iterator[pa.RecordBatch]:
        if (int(group[-1]) + 1).bit_length() + 3 * k > 62:
            code = np.unique(code, return_inverse=True)[1]
        key = group * (int(code.max(initial=0)) + 1) + code
        mid = np.array([q == centre and r is not None for r, q in zip(refs, queries)])[row]
        hit = np.isin(key, np.unique(key[mid]))
        counts = [np.bincount(row, weights, minlength=len(refs)).astype(np.int64) for weights in (None, hit)]
        names = to_arrow_schema(kind)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((refs, queries, *counts), names)], schema=names)

    return compared(rows, k, kind, made, large)


def letters_of(rows: DataFrame) -> tuple[DataFrame | None, bool]:
    """(ref_idx of the references that have letters without a code, null where none has; whether the sequences of any have more letters than a share), in one pass."""
    other = F.col("seq").rlike("[^" + LETTERS + "]")
    each = rows.groupBy("ref_idx").agg(F.sum(F.length("seq")).alias("total"), F.max(other).alias("odd"))
    most, odd = each.agg(F.max("total"), F.max("odd")).first()
    return (rows.where(other).select("ref_idx").distinct() if odd else None), (most or 0) > SHARE


def without_code(rows: DataFrame) -> DataFrame | None:
    """ref_idx of the references that have letters without a code; null where no sequence has."""
    odd = rows.where(F.col("seq").rlike("[^" + LETTERS + "]")).select("ref_idx").distinct()
    return None if odd.isEmpty() else odd


def split_by_letters(queries: DataFrame, reference: DataFrame) -> DataFrame | None:
    """ref_idx of the references that have letters without a code, their queries' too; null where no sequence has."""
    other = F.col("seq").rlike("[^" + LETTERS + "]")
    odd = queries.where(other).select("ref_idx").unionByName(reference.where(other).select("ref_idx")).distinct()
    return None if odd.isEmpty() else odd
