"""Free places for events of many sequences, claimed in rounds.

Every request wants ``width`` positions of its sequence that no other request has; smaller
ranks go first.  In a round each waiting request draws one of its free starts: starts are
counted over the free intervals of its sequence, and the drawn number finds its interval by a
running sum over intervals and draws together.  Claims that overlap one of a smaller rank
lose and draw again.

Priority holds even where room is scarce.  A claim of width v takes at most v + w - 1 starts
from requests of width w, so where every waiting request has more free starts than all
waiting claims could take, winners are settled at once; elsewhere only those whose rank is
below that of every loser of the sequence are.  A request without a free start can never
get one and is given up.  Each round settles the smallest waiting rank of each sequence at
least, so the rounds end; they are written to the shared folder and no sequence is gathered
in one task.  Where all sequences have the same few requests, as by a plan of variants, a task
goes through the rounds of many sequences by itself (:func:`allocate_few`): the driver plans
one stage whatever the number of rounds, and nothing is stored or shuffled.

A null or empty sequence has no room; a request wider than its sequence is given up in the
first round; a width of 0 or less needs no room and is not allowed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..storage import stored
from .segments import free_intervals

#: Rounds whose winners are read from tables of their own before they become one.
TABLES = 4
#: Requests of a sequence whose rounds are gone through in a task, and the numbers of its matrices.
FEW, NUMBERS = 1 << 9, 1 << 20


def _free_starts(free: DataFrame, waiting: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width, start, n, before: for each width that waits, the free intervals with n starts each and the starts before them."""
    wanted = waiting.select(*keys, "width").distinct()
    fits = free.join(wanted, keys).where("len >= width").withColumn("n", F.col("len") - F.col("width") + 1)
    earlier = Window.partitionBy(*keys, "width").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return fits.select(*keys, "width", "start", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def _claims(waiting: DataFrame, starts: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """Waiting requests with ``free`` (their free starts, 0 for none) and ``start``, the one that they draw."""
    totals = starts.groupBy(*keys, "width").agg(F.sum("n").alias("free"))
    drawn = waiting.join(totals, [*keys, "width"], "left").na.fill(0, ["free"]).withColumn("_at", F.when(F.col("free") > 0, F.pmod(number, F.col("free"))))
    columns = [*keys, "rank", "width", "free"]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    marks = starts.select(*keys, none("rank", "long"), "width", none("free", "long"), F.col("before").alias("_at"), F.lit(0).alias("_kind"), F.struct("start", "before").alias("_i"))
    asks = drawn.select(*columns, "_at", F.lit(1).alias("_kind"), F.lit(None).cast("struct<start: bigint, before: bigint>").alias("_i"))
    so_far = Window.partitionBy(*keys, "width").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asks).withColumn("_i", F.last("_i", ignorenulls=True).over(so_far)).where("_kind = 1")
    return both.select(*columns, (F.col("_i.start") + F.col("_at") - F.col("_i.before")).alias("start"))


def _losers(claims: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, rank of claims that overlap one of a smaller rank; claims meet in buckets as wide as the widest one."""
    stop = F.col("start") + F.col("width")
    dealt = claims.select(*keys, "rank", "start", stop.alias("stop"), F.explode(F.array_distinct(F.array(F.floor(F.col("start") / most), F.floor((stop - 1) / most)))).alias("_bucket"))
    other = dealt.select(*keys, "_bucket", F.col("rank").alias("_r"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    return dealt.join(other, [*keys, "_bucket"]).where("_r < rank and _a < stop and start < _b").select(*keys, "rank").distinct()


def allocate(totals: DataFrame, requests: DataFrame, keys: list[str], number, most_rounds: int = 1000) -> DataFrame:
    """keys, rank, width, start of every request (keys, rank, width) that gets a place; ``totals`` has keys and total.

    ``rank`` tells the requests of a sequence apart.  ``number(round)`` is a column that draws
    for a request in a round, from keys and rank.
    """
    waiting = stored(requests.select(*keys, F.col("rank").cast("long"), F.col("width").cast("long")).join(totals.select(*keys), keys), "requests")
    widest = waiting.agg(F.max("width")).first()[0]
    settled = None
    for turn in range(most_rounds):
        if settled is None:
            used = totals.select(*keys, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("len"))
        else:
            used = settled.select(*keys, "start", F.col("width").alias("len"))
        free = free_intervals(totals.join(waiting.select(*keys).distinct(), keys, "left_semi"), used.join(waiting.select(*keys).distinct(), keys, "left_semi"), keys)
        claims = stored(_claims(waiting, _free_starts(free, waiting, keys), keys, number(turn)), f"claims-{turn}")
        lost = _losers(claims.where("free > 0"), keys, max(int(widest or 1), 1)).withColumn("_lost", F.lit(True))
        group = Window.partitionBy(*keys)
        marked = claims.where("free > 0").join(lost, [*keys, "rank"], "left")
        n, widths = F.count("*").over(group), F.sum("width").over(group)
        ample = F.min((F.col("free") > widths + n * (F.col("width") - 1)).cast("int")).over(group) == 1
        first_lost = F.min(F.when(F.col("_lost"), F.col("rank"))).over(group)
        wins = F.col("_lost").isNull() & (ample | first_lost.isNull() | (F.col("rank") < first_lost))
        judged = stored(marked.select(*keys, "rank", "width", "start", wins.alias("_wins")), f"judged-{turn}")
        won = judged.where("_wins").drop("_wins")
        settled = won if settled is None else settled.unionByName(won)
        if turn % TABLES == TABLES - 1:  # else plans grow with the rounds, and the driver keeps them all
            settled = stored(settled, f"settled-{turn}")
        waiting = judged.where("not _wins").select(*keys, "rank", "width")
        if waiting.isEmpty():
            return settled
    raise RuntimeError("requests did not settle")


def _round(totals: np.ndarray, start: np.ndarray, waiting: np.ndarray, width: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts that requests draw, which of them win, which wait on) of sequences (rows) and their requests (columns by rank); ``start`` is -1 for those without a place."""
    total, own = totals[:, None], start >= 0
    first, last = np.where(own, start, total), np.where(own, start + width, total)
    order = np.argsort(first, axis=1, kind="stable")
    begins = np.concatenate([np.zeros_like(total), np.take_along_axis(last, order, axis=1)], axis=1)
    room = np.concatenate([np.take_along_axis(first, order, axis=1), total], axis=1) - begins
    free, drawn = np.zeros_like(start), np.zeros_like(start)
    for w in np.unique(width):
        n = np.maximum(room - w + 1, 0)
        until, of = np.cumsum(n, axis=1), np.flatnonzero(width == w)
        free[:, of] = until[:, -1:]
        at = np.mod(number[:, of], np.maximum(until[:, -1:], 1))
        here = np.minimum((until[:, None, :] <= at[:, :, None]).sum(axis=2), n.shape[1] - 1)
        drawn[:, of] = np.take_along_axis(begins, here, axis=1) + at - np.take_along_axis(until - n, here, axis=1)
    claims, stop = waiting & (free > 0), drawn + width
    meet = (drawn[:, None, :] < stop[:, :, None]) & (drawn[:, :, None] < stop[:, None, :]) & claims[:, None, :]
    lost = claims & (meet & np.tri(len(width), k=-1, dtype=bool)).any(axis=2)
    need = (claims * width).sum(axis=1, keepdims=True) + claims.sum(axis=1, keepdims=True) * (width - 1)
    ample = ((free > need) | ~claims).all(axis=1, keepdims=True)
    wins = claims & ~lost & (ample | (np.cumsum(lost, axis=1) == 0))
    return drawn, wins, claims & ~wins


def allocate_few(totals: DataFrame, requests: list[tuple[int, int]], number: Callable[[np.ndarray, np.ndarray, int], np.ndarray], most_rounds: int = 1000) -> DataFrame:
    """The key of each sequence, and ``starts``: the place of each of ``requests`` (rank, width; by rank), null where it gets none.

    Places are those of :func:`allocate` for sequences that all have these requests; ``totals``
    has a whole number as key and total, one row a sequence, and ``number(key, rank, round)`` draws in numpy.
    """
    ship(totals.sparkSession)
    key = totals.columns[0]
    rank, width = (np.array([r[i] for r in requests], np.int64) for i in range(2))
    many = max(NUMBERS // (len(requests) * (len(requests) + 1)), 1)
    given = totals.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("total"))

    def places(keys: np.ndarray, total: np.ndarray) -> np.ndarray:
        start, waiting = np.full((len(keys), len(rank)), -1, np.int64), np.ones((len(keys), len(rank)), bool)
        for turn in range(most_rounds):
            on = np.flatnonzero(waiting.any(axis=1))
            if not len(on):
                return start
            drawn, wins, waiting[on] = _round(total[on], start[on], waiting[on], width, number(keys[on, None], rank, turn))
            start[on] = np.where(wins, drawn, start[on])
        raise RuntimeError("requests did not settle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, many) for i in range(0, batch.num_rows, many)):
                start = places(part.column(0).to_numpy(), part.column(1).to_numpy()).ravel()
                ends = pa.array(np.arange(part.num_rows + 1) * len(rank), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(start, mask=start < 0))], names=[key, "starts"])

    return given.mapInArrow(run, f"{key} bigint, starts array<bigint>")
