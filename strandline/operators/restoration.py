"""Unknown bases of aligned rows put back on chunks of columns, in numpy and without an edit a column.

Rows meet their runs in one exchange, unless they carry them, and are cut into chunks of
``WIDTH`` columns; chunks of one stretch meet in a second, behind what their rows need there.
A task holds one row of letters, or how wide each column of one stretch becomes, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..storage import stored
from .rope import WIDTH

GAP, N = ord("-"), ord("N")
#: Letters that are given at once.
GIVEN = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_of(letters: np.ndarray) -> str:
    return letters.tobytes().decode("ascii") if letters.dtype == np.uint8 else letters.tobytes().decode("utf-32-le", "surrogatepass")


def single_letters(letters: np.ndarray) -> pa.Array:
    """Each letter as a string of its own."""
    if letters.dtype != np.uint8:
        return pa.array(list(text_of(letters)), pa.string())
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(np.arange(len(letters) + 1, dtype=np.int32)), pa.py_buffer(letters))


def runs_of(letters: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many other symbols stand before each run of ``symbol``, its length)."""
    edges = np.diff(np.pad((letters == symbol).astype(np.int8), 1))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    number = last - first
    return first - (np.cumsum(number) - number), number


def _covered(size: int, first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in disjoint runs (first, number); what lies behind the last place is left out."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, np.minimum(first, size), 1)
    np.add.at(marks, np.minimum(first + number, size), -1)
    return np.cumsum(marks[:-1]) > 0


def filled(letters: np.ndarray, idx: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters with gaps filled by unknown bases, aligned columns before which some are left over, how many)."""
    at, gaps = runs_of(letters, GAP)
    before = np.concatenate([[0], np.cumsum(gaps)])
    k = np.searchsorted(at, idx)
    here = np.zeros(len(idx), np.int64)
    some = k < len(at)
    some[some] = at[k[some]] == idx[some]
    here[some] = gaps[k[some]]
    column = idx + before[np.searchsorted(at, idx, side="right")]
    used = np.minimum(here, number)
    if used.any():
        letters = np.where(_covered(len(letters), (column - here)[used > 0], used[used > 0]), letters.dtype.type(N), letters)
    left = number > here
    return letters, column[left], (number - here)[left]


def widened(letters: np.ndarray, width: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Letters with ``width[i]`` columns before the i-th: ``left`` unknown bases at ``at``, and then gaps."""
    n, ends = len(letters), np.cumsum(width)
    out = np.full(n + int(ends[-1]), GAP, letters.dtype)
    out[np.arange(n) + ends[:n]] = letters
    if len(at):
        out[_covered(len(out), np.minimum(at, n) + ends[at] - width[at], left)] = N
    return out


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0 in as few bytes each as the greatest needs, which the first byte says."""
    size = np.min_scalar_type(int(values.max(initial=0))).itemsize
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpacked(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype(np.int64) if value else np.zeros(0, np.int64)


def _begins(columns: list[pa.Array]) -> np.ndarray:
    """Where rows of sorted or consecutive keys begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        for leaf in c.flatten() if pa.types.is_struct(c.type) else [c]:
            new[1:] |= pc.fill_null(pc.not_equal(leaf.slice(1), leaf.slice(0, len(leaf) - 1)), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def packed_runs(runs: DataFrame) -> DataFrame:
    """aln_id, row_idx, seq (none), idx, number: neighbouring runs of a row in one row, their places as differences."""
    ship(runs.sparkSession)
    none = F.lit(None)
    kind = runs.select("aln_id", "row_idx", none.cast("string").alias("seq"), none.cast("binary").alias("idx"), none.cast("binary").alias("number")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = _begins([batch.column(0), batch.column(1)])
            idx, number = (np.split(batch.column(c).to_numpy().astype(np.int64), begins[1:]) for c in (2, 3))
            orders = [np.argsort(i, kind="stable") for i in idx]
            idx, number = [np.diff(i[o], prepend=0) for i, o in zip(idx, orders)], [n[o] for n, o in zip(number, orders)]
            keys = [batch.column(c).take(pa.array(begins)).cast(names.field(c).type) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.nulls(len(begins), pa.string()), *(pa.array([packed(x) for x in v], pa.binary()) for v in (idx, number))], schema=names)

    return runs.where("idx is not null").select("aln_id", "row_idx", "idx", "number").mapInArrow(run, kind)


def _given(held: list[tuple], names: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), names)], schema=names)


def _parts(aln_id, row_idx, seq: str | None, where: np.ndarray, many: np.ndarray) -> Iterator[tuple]:
    """aln_id, row_idx, chunk, piece, at, left: filled chunks of a row with what it needs there, and (no row and no piece) the needs alone."""
    order = np.argsort(where, kind="stable")
    letters, column, left = filled(code_points(seq or ""), where[order], many[order])
    chunk = np.maximum(column - 1, 0) // WIDTH
    first = np.flatnonzero(np.diff(chunk, prepend=-1))
    at, n = np.split(column - chunk * WIDTH, first[1:]), np.split(left, first[1:])
    needs = {int(chunk[i]): (packed(a), packed(b)) for i, a, b in zip(first, at, n)}
    for c, need in needs.items():
        yield aln_id, None, c, None, *need
    if seq is not None:
        for c in range(max(-(-len(letters) // WIDTH), 1)):
            yield aln_id, row_idx, c, text_of(letters[c * WIDTH : (c + 1) * WIDTH]), *needs.get(c, (None, None))


def _dealt_carried(rows: DataFrame, kind) -> DataFrame:
    """Chunks and needs, as :func:`_parts` gives them, of rows (aln_id, row_idx, seq, n_runs) that carry their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        held, size = [], 0
        for batch in batches:
            runs = batch.column(3)
            ends, found = runs.offsets.to_numpy(), runs.values
            idx, number = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("idx", "number"))
            for k, (aln_id, row_idx, seq) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                held.extend(_parts(aln_id, row_idx, seq, idx[ends[k] : ends[k + 1]], number[ends[k] : ends[k + 1]]))
                size += len(seq)
                if size > GIVEN:
                    yield _given(held, names)
                    held, size = [], 0
        if held:
            yield _given(held, names)

    return rows.mapInArrow(run, kind)


def left_over(rows: DataFrame) -> DataFrame:
    """aln_id, c, left: how many unknown bases of a row (aln_id, seq without N, n_runs) find no gap at aligned column c; rows of an alignment that follow each other give the most of them."""
    ship(rows.sparkSession)
    kind = rows.select("aln_id", F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("left")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, ids = batch.column(2), batch.column(0)
            ends, found = runs.offsets.to_numpy(), runs.values
            idx, number = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("idx", "number"))
            needs = [filled(code_points(seq or ""), idx[i:j], number[i:j])[1:] for seq, i, j in zip(batch.column(1).to_pylist(), ends, ends[1:])]
            begins = _begins([ids])
            group = np.repeat(np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(needs)))), [len(c) for c, _ in needs])
            column, left = (np.concatenate(x) for x in zip(*needs))
            order = np.lexsort((column, group))
            column, left, group = column[order], left[order], group[order]
            first = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(column, prepend=-1) != 0))
            most = np.maximum.reduceat(left, first) if len(first) else left
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(begins[group[first]])).cast(names.field(0).type), pa.array(column[first]), pa.array(most)], schema=names)

    return rows.select("aln_id", "seq", "n_runs").mapInArrow(run, kind)


def _dealt(both: DataFrame, kind, strays: bool) -> DataFrame:
    """Chunks and needs, as :func:`_parts` gives them, of rows that lie behind their packed runs."""

    def of(aln_id, row_idx, seq: str | None, idx: list[bytes], number: list[bytes]) -> Iterator[tuple]:
        where, many = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.cumsum(unpacked(b)) for b in idx], map(unpacked, number)))
        yield from _parts(aln_id, row_idx, seq, where, many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        at, idx, number, held, size, done = None, [], [], [], 0, True
        for batch in batches:
            for aln_id, row_idx, seq, i, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (aln_id, row_idx) != at:
                    if not done and strays:  # runs of a row that is not there
                        held.extend(of(*at, None, idx, number))
                    at, idx, number, done = (aln_id, row_idx), [], [], True
                if seq is None:
                    idx.append(i)
                    number.append(n)
                    done = False
                    continue
                held.extend(of(aln_id, row_idx, seq, idx, number))
                done, size = True, size + len(seq)
                if size > GIVEN:
                    yield _given(held, names)
                    held, size = [], 0
        if not done and strays:
            held.extend(of(*at, None, idx, number))
        if held:
            yield _given(held, names)

    return both.mapInArrow(run, kind)


def _dealt_named(both: DataFrame, kind) -> DataFrame:
    """Chunks and needs, as :func:`_parts` gives them, of rows (aln_id, name, seq) that lie behind the records (seq_idx, length, runs) of their name; the first of them counts."""

    def of(aln_id, name, seq: str, records: list[tuple]) -> Iterator[tuple]:
        if not records:
            raise ValueError(f"no record of sequence {name}")
        seq_idx, length = records[0][:2]
        if length is not None and length != len(seq) - seq.count("-"):
            raise ValueError(f"the record has another length than sequence {name}")
        own = [r for r in records if r[0] == seq_idx]
        where, many = (np.concatenate([np.zeros(0, np.int64), *(r[c] for r in own)]) for c in (2, 3))
        yield from _parts(aln_id, {"seq_idx": seq_idx, "name": name}, seq, where, many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        key, records, held, size = None, [], [], 0
        for batch in batches:
            runs = batch.column(5)
            ends, found = runs.offsets.to_numpy(), runs.values
            idx, number = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("idx", "number"))
            for k, (aln_id, name, seq, seq_idx, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if (aln_id, name) != key:
                    key, records = (aln_id, name), []
                if seq is None:
                    records.append((seq_idx, length, idx[ends[k] : ends[k + 1]], number[ends[k] : ends[k + 1]]))
                    continue
                held.extend(of(aln_id, name, seq, records))
                size += len(seq)
                if size > GIVEN:
                    yield _given(held, names)
                    held, size = [], 0
        if held:
            yield _given(held, names)

    return both.mapInArrow(run, kind)


def _rebuilt(dealt: DataFrame, kind) -> DataFrame:
    """aln_id, row_idx, chunk, piece: chunks, sorted behind the needs of their stretch, with its columns put in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        key, width, some, held, size = None, np.zeros(WIDTH + 1, np.int64), False, [], 0
        for batch in batches:
            for aln_id, row_idx, chunk, piece, at, left in zip(*(c.to_pylist() for c in batch.columns)):
                if (aln_id, chunk) != key:
                    key, some = (aln_id, chunk), False
                    width[:] = 0
                if piece is None:
                    at, some = unpacked(at), True
                    width[at] = np.maximum(width[at], unpacked(left))
                    continue
                if some:
                    piece = text_of(widened(code_points(piece), width, unpacked(at), unpacked(left)))
                held.append((aln_id, row_idx, chunk, piece))
                size += len(piece)
                if size > GIVEN:
                    yield _given(held, names)
                    held, size = [], 0
        if held:
            yield _given(held, names)

    return dealt.mapInArrow(run, kind)


def restored_rope(aligned: DataFrame, n_runs: DataFrame | None = None, strays: bool = True) -> DataFrame:
    """aln_id, row_idx, chunk, piece: the aligned rows (aln_id, row_idx, seq without N) with their unknown bases back, in chunks.

    ``n_runs`` may be packed already.  Runs of rows that are not there widen the others, too, unless not ``strays``.
    Without ``n_runs`` rows carry their own in a column of that name, as ``with_runs`` gives it, and need not meet them.
    """
    ship(aligned.sparkSession)
    keys, empty = ["aln_id", "row_idx"], F.lit(None).cast("binary")
    given = aligned.where("seq is not null")
    rows = given.select(*keys, "seq", empty.alias("idx"), empty.alias("number"))
    kind = rows.select("aln_id", "row_idx", F.lit(None).cast("long").alias("chunk"), F.col("seq").alias("piece"), empty.alias("at"), empty.alias("left")).schema
    for field in kind:
        field.nullable = True
    if n_runs is None:
        parts = _dealt_carried(given.select(*keys, "seq", "n_runs"), kind)
    else:
        both = rows.unionByName(n_runs if "seq" in n_runs.columns else packed_runs(n_runs)).repartition(*keys).sortWithinPartitions(*keys, F.col("seq").isNotNull())
        parts = _dealt(both, kind, strays)
    return _by_stretch(parts)


def _by_stretch(parts: DataFrame) -> DataFrame:
    dealt = parts.repartition("aln_id", "chunk").sortWithinPartitions("aln_id", "chunk", F.col("piece").isNotNull())
    return _rebuilt(dealt, dealt.select("aln_id", "row_idx", "chunk", "piece").schema)


def named_rope(aligned: DataFrame, records: DataFrame) -> DataFrame:
    """aln_id, row_idx (seq_idx, name), chunk, piece: aligned rows (aln_id, name, seq without N) with the unknown bases of their records (aln_id, name, seq_idx, length, runs) back.

    Rows and records meet in one exchange, where they are checked; a row without a record, or with another length, is an error.
    Chunks are stored behind that, so an error shows at once and records are parsed only once.
    """
    ship(aligned.sparkSession)
    runs = F.lit(None).cast("array<struct<idx: bigint, number: bigint>>")
    rows = aligned.where("seq is not null").select("aln_id", "name", "seq", *(F.lit(None).cast("long").alias(c) for c in ("seq_idx", "length")), runs.alias("runs"))
    of = records.select("aln_id", "name", F.lit(None).cast("string").alias("seq"), F.col("seq_idx").cast("long").alias("seq_idx"), F.col("length").cast("long").alias("length"), F.col("runs").cast(rows.schema["runs"].dataType).alias("runs"))
    both = rows.unionByName(of).repartition("aln_id", "name").sortWithinPartitions("aln_id", "name", F.col("seq").isNotNull(), "seq_idx")
    empty = F.lit(None).cast("binary")
    kind = both.select("aln_id", F.struct("seq_idx", "name").alias("row_idx"), F.lit(None).cast("long").alias("chunk"), F.col("seq").alias("piece"), empty.alias("at"), empty.alias("left")).schema
    for field in kind:
        field.nullable = True
    return _by_stretch(stored(_dealt_named(both, kind), "named-parts"))
