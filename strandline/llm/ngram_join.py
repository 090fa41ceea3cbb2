"""N-gram Jaccard join by T-occurrence search.

Two texts are linked when the Jaccard similarity of their word-shingle sets reaches a
threshold; equivalently when the shingles' inverted lists hold both texts at least T
times, T following from the set sizes.  DivideSkip splits a text's lists: its L longest
are skipped, the others are merged, and a text that the merge finds at least ``T - L``
times is looked up in the long ones by binary search.  Here, on Spark:

1. Texts with equal sets are one class; only classes take part.
2. Shingles are ordered by the length of their lists: estimated from a share of the
   classes, chosen by hash and counted over all tasks, so that the order holds however
   texts are dealt to tasks, and from what single tasks see of all classes.  The scan gets
   the logarithm of the longest list in each of 2**24 buckets of hashes, one byte each:
   where shingles share a bucket the shorter list is taken for a longer one.  Only a text's
   ``n - T + ell`` shortest lists are built, so a partner occurs at least ``ell`` times among
   them, or as often as its own ``ell`` if that is less.  The lists beyond the ``n - T + 1``
   that any partner calls for are taken only while they are short: short texts of one
   template do not merge the template's own lists.
3. A sort by shingle puts each list together; one streaming pass with bounded memory
   merges it.  Lists up to ``short`` members give pairs, which are counted; those with
   ``ell`` occurrences are looked up in the partner's sorted set by binary search.  Lists
   that are known to be very long are dealt to many tasks.
4. Longer lists are searched family by family.  Members of a large family are first
   compared with the one that most of its lists share; those it does not link are searched
   against the whole family.  Either is dealt out in blocks, and each pair of blocks is
   searched by itself with DivideSkip over its own inverted lists, returning only links
   that join separate trees.  A third of all rows in one list is so many block pairs, not
   one task.
5. Connected components of the links, then of the documents.

Shingles and classes stand as 64-bit hashes, which are not compared: among 10**9 classes
two that differ agree with a chance of 3 %.  Nothing is capped or sampled: the table in 2
only orders lists, and any order gives the same links.

Null, empty and wordless texts have an empty set and no link.  Whole texts are read, in
slices of about 1 MB, a longer text alone.  Repeated rows, and rows with one key and
different texts, are rows of their own: each gets its class's component.  Null keys are
passed over where the smallest key is sought; a component with null keys alone has none.
Further columns are not returned, and clash with none here; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import components
from .runtime import lean, slices, stored
from .wordhash import mix, shingle_sets


def overlap_needed(a: int, b: int, num: int, den: int) -> int:
    """Shared shingles that sets of sizes a and b need: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def least_overlap(n: int, num: int, den: int) -> int:
    """The fewest shared shingles that any partner of a set of size n has."""
    return -(-num * n // den)


#: The highest level (one more than the logarithm of its length) of a list that is merged beyond those that are needed.
FURTHER = 6


def merged_lists(levels: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """(how many of a set's lists are merged, ``ell``: how often a partner must occur in them), given all lists' ``levels``, lowest first."""
    n = len(levels)
    need = least_overlap(n, num, den)
    first = n - need + 1
    further = levels[first : n - need + min(2 + n // 20, need)]
    ell = 1 + int(np.searchsorted(further, FURTHER, side="right"))
    return n - need + ell, ell


def class_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each set."""
    with np.errstate(over="ignore"):
        return np.array([mix(np.array([x.sum(dtype=np.uint64) * np.uint64(31) + np.bitwise_xor.reduce(mix(x)) + np.uint64(len(x))]))[0] if len(x) else 0 for x in sets], dtype=np.uint64).view(np.int64)


#: One class in so many is counted over all tasks to order lists; a task counts so many shingles at once, and remembers so many classes.
RATE, COUNTED, REMEMBERED = 16, 2_000_000, 200_000


def _scan(k: int, key_type: pa.DataType):
    """Rows (key, class, set size) of documents (kind 0), and of shingles that classes share.

    Kind 1 are shingles that a task has seen in several classes, kind 2 those of a share of
    the classes: the first finds lists early, the second does so whatever a task sees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some, size, seen = [], [], 0, set()

        def counted(kind: int, sets: list[np.ndarray], least: int) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            values, counts = values[counts >= least], counts[counts >= least]
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.nulls(n, key_type), pa.array(values.view(np.int64)), pa.array(counts)], names=["kind", "key", "id", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                ids, counts = class_keys(sets), np.array([len(x) for x in sets], dtype=np.int64)
                for x, c in zip(sets, ids.tolist()):
                    if len(x) and c not in seen:
                        seen.add(c)
                        held.append(x)
                        size += len(x)
                        if c % RATE == 0:
                            some.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int8)), part.column("key"), pa.array(ids), pa.array(counts)], names=["kind", "key", "id", "n"])
                if size > COUNTED:
                    yield counted(1, held, 2)
                    yield counted(2, some, 1)
                    held, some, size = [], [], 0
                if len(seen) > REMEMBERED:
                    seen.clear()
        yield counted(1, held, 2)
        yield counted(2, some, 1)

    return run


#: Buckets of hashes in the table that orders lists, and in a row that makes it up, as powers of two.
BUCKETS, ROW = 24, 12


def _levels(shared: DataFrame) -> DataFrame:
    """(row, body): for ``ROW`` bits' worth of buckets each, the largest level (one more than the logarithm of n) of its shingles (id, n)."""

    def pack(table: pa.Table) -> pa.Table:
        body = np.zeros(1 << ROW, dtype=np.uint8)
        np.maximum.at(body, table.column("slot").to_numpy(), table.column("level").to_numpy().astype(np.uint8))
        return pa.table({"row": table.column("row").slice(0, 1), "body": pa.array([body.tobytes()], pa.binary())})

    bucket = F.shiftrightunsigned("id", 64 - BUCKETS)
    level = (F.floor(F.log2("n")) + 1).cast("int")
    placed = shared.select(F.shiftright(bucket, ROW).cast("int").alias("row"), bucket.bitwiseAND((1 << ROW) - 1).cast("int").alias("slot"), level.alias("level"))
    return placed.groupBy("row").applyInArrow(pack, "row int, body binary")


def order_table(rows: list[tuple[int, bytes]]) -> np.ndarray:
    """The level of every bucket, 0 where nothing is known."""
    out = np.zeros((1 << (BUCKETS - ROW), 1 << ROW), dtype=np.uint8)
    for row, body in rows:
        out[row] = np.frombuffer(body, dtype=np.uint8)
    return out.reshape(-1)


class Order:
    """Ranks shingles by the level of their bucket, then by hash."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels

    def sorted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, their levels), the shortest lists first."""
        levels = self.levels[x >> np.uint64(64 - BUCKETS)]
        if not levels.any():
            return x, levels
        order = np.argsort(levels, kind="stable")
        return x[order], levels[order]


#: Members of a very long list that go to one task.
SHARE = 4096


def _post(k: int, num: int, den: int, held):
    """Rows (shingle, part, class, set size, ``ell``) of the merged lists; a task posts a class once as far as it remembers.

    A list that must be expected to be longer than ``SHARE`` has parts 1 and up, any other one part 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(held.value), set()
        for batch in batches:
            for part in slices(batch, "text"):
                out, many, ids, sizes, ells = [], [], [], [], []
                sets = shingle_sets(part.column("text"), k)
                for x, c in zip(sets, class_keys(sets).tolist()):
                    if len(x) and c not in seen:
                        seen.add(c)
                        lists, levels = order.sorted(x)
                        count, ell = merged_lists(levels, num, den)
                        out.append(lists[:count])
                        many.append((np.int64(1) << levels[:count].astype(np.int64)) // (2 * SHARE))
                        ids.append(c)
                        sizes.append(len(x))
                        ells.append(ell)
                lengths = [len(x) for x in out]
                shingle = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
                parts = np.concatenate(many) if many else np.zeros(0, np.int64)
                members = np.repeat(np.array(ids, np.int64), lengths)
                parts = np.where(parts > 0, (members >> 8) % np.maximum(parts + 1, 1) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(parts), pa.array(members), *(pa.array(np.repeat(np.array(v, np.int32), lengths)) for v in (sizes, ells))], names=["shingle", "part", "id", "n", "ell"])
                if len(seen) > REMEMBERED:
                    seen.clear()

    return run


def _merge(num: int, den: int, short: int):
    """Merges sorted lists: counted pairs (kind 0) of short ones, members (kind 1) of long ones.

    Holds at most one list of ``short`` members and a bounded table of pair counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[int, int, int], int] = {}
        members: list[tuple[int, int]] = []
        token, own, long = None, [], False  # a list, or a part of one

        def close() -> None:
            if not long and len(own) > 1:
                for i, (b, nb, eb) in enumerate(own):
                    for a, na, ea in own[:i]:
                        if min(na, nb) * den >= num * max(na, nb):
                            pair = (a, b, min(ea, eb))
                            pairs[pair] = pairs.get(pair, 0) + 1

        def flush() -> pa.RecordBatch:
            rows = [(0, *p, t, None) for p, t in pairs.items()] + [(1, c, None, None, None, t) for t, c in members]
            pairs.clear()
            members.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])], names=["kind", "a", "b", "ell", "times", "shingle"])

        for batch in batches:
            tokens, parts = batch.column("shingle").to_numpy(), batch.column("part").to_numpy()
            # rows whose shingle stands alone in this batch and is not at its edge need no look
            same = parts > 0
            if len(tokens):
                equal = tokens[1:] == tokens[:-1]
                same[1:] |= equal
                same[:-1] |= equal
                same[0] = same[-1] = True
            look = np.flatnonzero(same)
            ids, sizes, ells = (batch.column(name).to_numpy()[look].tolist() for name in ("id", "n", "ell"))
            for t, p, c, n, e in zip(tokens[look].tolist(), parts[look].tolist(), ids, sizes, ells):
                if (t, p) != token:
                    close()
                    token, own, long = (t, p), [], p > 0
                if own and own[-1][0] == c:
                    continue
                if long:
                    own = [(c, n, e)]
                    members.append((t, c))
                else:
                    own.append((c, n, e))
                    if len(own) > short:
                        members += [(t, x[0]) for x in own]
                        long = True
                if len(members) > 50_000 or len(pairs) > 100_000:
                    yield flush()
        close()
        yield flush()

    return run


def probe(small: np.ndarray, large: np.ndarray) -> int:
    """How many of ``small`` a binary search finds in ``large``; both sorted and distinct."""
    if not len(small) or not len(large):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small))


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    return probe(small, large) >= max(1, overlap_needed(len(x), len(y), num, den))


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(c)] for c in ("set_a", "set_b")]
            keep = pa.array([linked(x, y, num, den) for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def divide_skip(queries: list[np.ndarray], index: list[np.ndarray], num: int, den: int, same: bool = False) -> Iterator[tuple[int, int]]:
    """Links between ``queries`` and ``index`` (positions), leaving out those that only close a cycle.

    With ``same``, both are one block and each pair is met once.  For each query the
    longest inverted lists are skipped, the short ones are merged by sorting their runs
    of ids, and ids with enough occurrences are looked up by binary search.
    """
    if not index:
        return
    ids = np.repeat(np.arange(len(index)), [len(x) for x in index])
    tokens = np.concatenate(index)
    order = np.argsort(tokens, kind="stable")
    tokens, ids = tokens[order], ids[order]
    sizes = np.array([len(x) for x in index])
    parent = list(range(len(queries) + (0 if same else len(index))))
    shift = 0 if same else len(queries)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for q, x in enumerate(queries):
        if not len(x):
            continue
        low, high = np.searchsorted(tokens, x), np.searchsorted(tokens, x, side="right")
        lengths = high - low
        need = least_overlap(len(x), num, den)
        skipped = min(need - 1, int(need / (0.01 * math.log2(max(2, int(lengths.max()))) + 1)))
        by_length = np.argsort(lengths, kind="stable")[: len(x) - skipped]
        by_length = by_length[lengths[by_length] > 0]
        if not len(by_length):
            continue
        counts = np.bincount(np.concatenate([ids[low[i] : high[i]] for i in by_length]), minlength=len(index))
        found = np.flatnonzero((counts >= need - skipped) & (np.minimum(sizes, len(x)) * den >= num * np.maximum(sizes, len(x))))
        for i in found[found > q].tolist() if same else found.tolist():
            a, b = root(q), root(i + shift)
            if a != b and linked(x, index[i], num, den):
                parent[b] = a
                yield q, i


def _block(num: int, den: int):
    """Searches one pair of blocks: members of side 0 against those of side 1, or one block by itself."""

    def run(table: pa.Table) -> pa.Table:
        sides = table.column("side").to_numpy()
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("set")]
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if len(right):
            out = [(ids[left[i]], ids[right[j]]) for i, j in divide_skip([sets[i] for i in left], [sets[i] for i in right], num, den)]
        else:
            block = [sets[i] for i in left]
            out = [(ids[left[i]], ids[left[j]]) for i, j in divide_skip(block, block, num, den, same=True)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _sets(k: int):
    """(class, set) of texts; rows whose text is of another class than the one asked for are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                own = np.flatnonzero(class_keys(sets) == part.column("id").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(own)), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["id", "set"])

    return run


def _families(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(head, id: members of long lists; head, pivot, size of each family of two or more).

    Lists with one smallest member, the head, are mostly those of one family, so they are
    searched together: their members once, not once for each list.  The pivot is the
    member that most of the lists have.
    """
    heads = members.groupBy("shingle").agg(F.min("id").alias("head"))
    family = stored(members.join(heads, "shingle").groupBy("head", "id").agg(F.count("*").alias("lists")), "families")
    sizes = family.groupBy("head").agg(F.max(F.struct("lists", "id"))["id"].alias("pivot"), F.count("*").alias("size")).where("size > 1")
    return family.select("head", "id"), stored(sizes, "family-sizes")


def _star(family: DataFrame, large: DataFrame, sets: DataFrame, num: int, den: int, share: int = 1024) -> DataFrame:
    """Links (a: pivot, b) of large families; a pivot's set is repeated for every ``share`` members."""
    salt = lambda size: F.floor(size / share).cast("int")
    pivots = large.join(sets.withColumnRenamed("id", "pivot").withColumnRenamed("set", "set_a"), "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), salt(F.col("size")))))
    dealt = family.join(large, "head").where("id <> pivot").select("head", "id", F.pmod(F.hash("id"), salt(F.col("size")) + 1).alias("salt"))
    both = dealt.join(sets.withColumnRenamed("set", "set_b"), "id").join(pivots.select("head", "salt", "pivot", "set_a"), ["head", "salt"])
    return both.select(F.col("pivot").alias("a"), F.col("id").alias("b"), "set_a", "set_b").mapInArrow(lean(_verify(num, den)), "a long, b long")


def _small_blocks(family: DataFrame, small: DataFrame, block: int) -> DataFrame:
    """Members repeated for each pair of blocks of their family: (head, p, q, side, id)."""
    sizes = small.select("head", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = family.join(sizes, "head").withColumn("own", F.pmod(F.hash("id"), F.col("blocks")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("head", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.lit(False).alias("large"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id")


def _large_blocks(family: DataFrame, large: DataFrame, star: DataFrame, block: int) -> DataFrame:
    """Members that the pivot does not link (side 0) against all of their family (side 1), by pairs of blocks."""
    linked_ = star.select(F.col("a").alias("pivot"), F.col("b").alias("id"))
    every = family.join(large, "head")
    rest = stored(every.where("id <> pivot").join(linked_, ["pivot", "id"], "left_anti").select("head", "id"), "unlinked")
    counts = rest.groupBy("head").agg(F.ceil(F.count("*") / block).cast("int").alias("rows")).join(large.select("head", F.ceil(F.col("size") / block).cast("int").alias("columns")), "head")
    deal = lambda df, own, other: df.join(counts, "head").withColumn("own", F.pmod(F.hash("id"), F.col(own))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    asked = deal(rest, "rows", "columns").select("head", F.col("own").alias("p"), F.col("other").alias("q"), F.lit(True).alias("large"), F.lit(0).alias("side"), "id")
    return asked.unionByName(deal(family, "columns", "rows").select("head", F.col("other").alias("p"), F.col("own").alias("q"), F.lit(True).alias("large"), F.lit(1).alias("side"), "id"))


def links_and_classes(df: DataFrame, key: str, text: str, k: int, num: int, den: int, short: int = 32, block: int = 256, broadcast_rows: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """(links between classes: a, b; documents: key, id, n_shingles).

    The links connect every two classes that similarity links, directly or through
    others; ``broadcast_rows`` bounds the keys that are broadcast to the scan for sets
    (more are joined by a shuffle).
    """
    kind = dict(df.dtypes)[key]
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    scan = stored(docs.mapInArrow(lean(_scan(k, to_arrow_type(docs.schema["key"].dataType))), f"kind byte, key {kind}, id long, n long"), "shingle-scan")
    documents = scan.where("kind = 0").select("key", "id", F.col("n").alias("n_shingles"))
    each = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    shared = scan.where("kind > 0").groupBy("id").agg(each(1).alias("near"), each(2).alias("far")).where("near > 0 or far > 1")
    levels = _levels(shared.select("id", F.greatest("near", F.col("far") * RATE).alias("n")))
    held = df.sparkSession.sparkContext.broadcast(order_table([(r["row"], r["body"]) for r in levels.collect()]))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = docs.mapInArrow(lean(_post(k, num, den, held)), "shingle long, part int, id long, n int, ell int")
    merged = stored(posted.repartition(partitions, "shingle", "part").sortWithinPartitions("shingle", "part", "id").mapInArrow(lean(_merge(num, den, short)), "kind byte, a long, b long, ell int, times long, shingle long"), "merged-lists")
    pairs = merged.where("kind = 0").groupBy("a", "b", "ell").agg(F.sum("times").alias("times")).where("times >= ell").select("a", "b")
    members = merged.where("kind = 1").select("shingle", F.col("a").alias("id"))
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(members.select("id")).distinct()
    classes = documents.where("n_shingles > 0").groupBy("id").agg(F.min("key").alias("class_key"))
    chosen = stored(classes.join(wanted, "id"), "chosen-classes")
    few = chosen.count() <= broadcast_rows
    found = docs.join(F.broadcast(chosen) if few else chosen, F.col("key").eqNullSafe(F.col("class_key"))).select("id", "text")
    sets = stored(found.mapInArrow(lean(_sets(k)), "id long, set binary").dropDuplicates(["id"]), "shingle-sets")
    checked = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").mapInArrow(lean(_verify(num, den)), "a long, b long")
    family, sizes = _families(members)
    small, large = (sizes.where(F.col("size") <= 2 * block), sizes.where(F.col("size") > 2 * block))
    blocks = _small_blocks(family, small, block)
    if not large.isEmpty():
        star = stored(_star(family, large, sets, num, den), "star")
        blocks, checked = blocks.unionByName(_large_blocks(family, large, star, block)), checked.unionByName(star)
    searched = blocks.join(sets, "id").groupBy("head", "p", "q", "large").applyInArrow(_block(num, den), "a long, b long")
    return checked.unionByName(searched).distinct(), documents


def near_duplicate_components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, **more) -> DataFrame:
    """(key, n_shingles, component_id) of every row; the component is the smallest key that links reach.

    Sets link when ``den`` times their intersection is at least ``num`` times their union.
    """
    links, documents = links_and_classes(df, key, text, k, num, den, **more)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    smallest = documents.where("n_shingles > 0").groupBy("id").agg(F.min("key").alias("least"))
    rooted = smallest.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("component", "id"))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(by_root, "root").select("id", "component_id")
    return documents.join(by_class, "id", "left").select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
