"""Running sums in two levels: inside blocks, and over the totals of blocks.

No window goes over a whole sequence's rows: places are dealt to tasks by (keys, block), and
only one row a block is summed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def totals_before(totals: DataFrame, keys: list[str], block: str, values: list[str]) -> DataFrame:
    """keys, block, values: the sums of ``values`` over the earlier blocks of each key; 0 for the first."""
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, block, *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in values))


def running(rows: DataFrame, keys: list[str], place: str, values: dict[str, Column], exclusive: bool = False, ties: tuple[str, ...] = (), width: int = BLOCK) -> DataFrame:
    """Adds, for each name of ``values``, the sum of its column over the rows of a key up to each row (``exclusive``: before it).

    Rows are ordered by the whole number ``place`` and then ``ties``; a block has ``width`` places.
    """
    named = rows.withColumns({f"_v_{k}": v for k, v in values.items()}).withColumn("_block", F.floor(F.col(place) / width))
    inside = Window.partitionBy(*keys, "_block").orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    totals = named.groupBy(*keys, "_block").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values))
    before = totals_before(totals, [*keys], "_block", [f"_t_{k}" for k in values])
    local = named.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in values})
    joined = local.join(before, [*keys, "_block"])
    return joined.withColumns({k: F.col(k) + F.col(f"_t_{k}") for k in values}).select(*rows.columns, *values)
