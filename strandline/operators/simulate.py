"""Seeded simulation of sequences, small variants and structural variants.

Draws come from an arithmetic generator over (seed, position, purpose), so a run can be
repeated and checked in SQL.  Structural variants get places from a layout of disjoint
slots, so that every reference position is changed at most once without a sequential
allocator.  Coordinates are 0-based and half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .allocate import FEW, allocate, allocate_few
from .draws import hits, least_draws, numbers
from .rope import edited, from_rope, to_rope
from .runs import splice

#: Codes of variant types.
SMALL_INSERT, SMALL_DELETE, SMALL_SUBSTITUTE, BIG_INSERT, BIG_DELETE, TANDEM, TRANSLOCATION, INVERSION, INVERTED_TRANSLOCATION, DISPERSED, INVERTED_DUPLICATION = 1, 2, 3, 4, 5, 6, 7, 8, 9, 61, 62
REPORTABLE_ABOVE = 5
ELSEWHERE = (DISPERSED, INVERTED_DUPLICATION, TRANSLOCATION, INVERTED_TRANSLOCATION)
INVERTED = (INVERSION, INVERTED_TRANSLOCATION, INVERTED_DUPLICATION)


def draw(seed: Column, at: Column, purpose: int) -> Column:
    """A number in 0 .. 2**31 - 1."""
    x = (at * 1103515245 + seed * 12345 + purpose * 69069 + 12345) % 2147483648
    return ((x * 48271 + 11) % 2147483647).cast("long")


def base_of(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, "ACGT")), (number % 4 + 1).cast("int"))


def other_base(base: Column, number: Column) -> Column:
    """One of the three other bases; anything but A, C, G and T stays."""
    at = F.instr(F.lit("ACGT"), base)
    return F.when(at > 0, F.lit("ACGT").substr(((at + number % 3) % 4 + 1).cast("int"), F.lit(1))).otherwise(base)


def random_sequences(ids: DataFrame, length: int, seed: int = 1) -> DataFrame:
    """seq_idx, seq: uniform random bases for each seq_idx."""
    places = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: base_of(F.shiftright(draw(F.col("seq_idx") + seed, p.cast("long"), 1), 8)))
    return ids.select("seq_idx", F.array_join(places, "").alias("seq"))


def balanced_sequences(ids: DataFrame, length: int, seed: int = 1) -> DataFrame:
    """seq_idx, seq: a quarter of each base (G takes the remainder), shuffled."""
    quarter = length // 4
    cells = ids.select("seq_idx", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("pos"))
    rank = F.row_number().over(Window.partitionBy("seq_idx").orderBy(draw(F.col("seq_idx") + seed, F.col("pos").cast("long"), 2), "pos")) - 1
    base = F.when(rank < quarter, "A").when(rank < 2 * quarter, "C").when(rank < 3 * quarter, "T").otherwise("G")
    cells = cells.withColumn("base", base)
    return cells.groupBy("seq_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda c: c["base"]), "").alias("seq"))


def distinct_positions(seqs: DataFrame, n: int, purpose: int, seed: int = 1, keys: tuple[str, ...] = ("seq_idx",)) -> DataFrame:
    """keys, pos, base of the n positions of each sequence (keys, seq) with the smallest draws; all where a sequence is shorter."""
    return least_draws(seqs, [*keys], n, F.col(keys[0]) + seed, purpose).drop("rank")


def substitute(seqs: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """seq_idx, pos, base, new_base at n distinct positions of sequences (seq_idx, seq)."""
    return distinct_positions(seqs, n, 3, seed).withColumn("new_base", other_base(F.col("base"), F.shiftright(draw(F.col("seq_idx") + seed, F.col("pos"), 4), 8)))


def aligned_samples(template: DataFrame, samples: int, n_sub: int, n_ins: int, n_del: int, seed: int = 1) -> DataFrame:
    """seq_idx, sample, seq: sample 0 is the template; others have substitutions and deletions at disjoint sites and insertions.

    Insertion sites are the union over samples; a sample without an insertion there has a
    gap.  Sites are chosen chunk by chunk, and samples are edits of the template's rope.
    """
    keys = ["seq_idx", "sample"]
    changed = template.select("seq_idx", "seq", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).where("sample > 0")
    key = F.col("seq_idx") * 1009 + F.col("sample") + seed
    new = F.when(F.col("rank") <= n_sub, other_base(F.col("base"), F.shiftright(draw(key, F.col("pos"), 7), 8))).otherwise("-")
    changes = least_draws(changed, keys, n_sub + n_del, key, 5).select(*keys, F.col("pos").alias("start"), F.lit(1).cast("long").alias("len"), new.alias("str_value"))
    own = stored(least_draws(changed, keys, n_ins, key, 6).select(*keys, "pos"), "insertion-sites")
    every = own.select("seq_idx", "pos").distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    put = F.when(F.col("_own"), base_of(F.shiftright(draw(key, F.col("pos"), 8), 8))).otherwise("-")
    inserts = every.join(own.withColumn("_own", F.lit(True)), [*keys, "pos"], "left").select(*keys, F.col("pos").alias("start"), F.lit(0).cast("long").alias("len"), put.alias("str_value"))
    copies = to_rope(template, ("seq_idx",)).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return from_rope(edited(copies, changes.unionByName(inserts), tuple(keys)), tuple(keys))


def place_variants(reference: DataFrame, wanted: dict[int, tuple[int, int]], seed: int = 1) -> DataFrame:
    """seq_idx, sv_id, sv_type, a_index, len, b_site: ``wanted`` variants (type: count, length) in disjoint slots.

    The sequence is cut into slots as wide as the longest variant and one more base; each
    variant takes a slot, and a second one for what is inserted elsewhere, in the order
    of the slots' draws.  Sequences with too few slots get the variants that fit.
    """
    rows = [(i, t, n) for i, (t, n) in enumerate((t, n) for t, (count, n) in wanted.items() for _ in range(count))]
    width = max((n for _, _, n in rows), default=1) + 1
    spark = reference.sparkSession
    plan = spark.createDataFrame(rows or [], "sv_id long, sv_type int, len long")
    slots = reference.select("seq_idx", F.explode(F.expr(f"sequence(0, cast(length(seq) div {width} as int) - 1)")).alias("slot")).where("slot >= 0")
    order = Window.partitionBy("seq_idx").orderBy(draw(F.col("seq_idx") + seed, F.col("slot").cast("long"), 9), "slot")
    ranked = slots.withColumn("rank", F.row_number().over(order) - 1)
    first = ranked.where("rank % 2 = 0").select("seq_idx", (F.col("rank") / 2).cast("long").alias("sv_id"), (F.col("slot") * width).cast("long").alias("a_index"))
    second = ranked.where("rank % 2 = 1").select("seq_idx", ((F.col("rank") - 1) / 2).cast("long").alias("sv_id"), (F.col("slot") * width).cast("long").alias("b_site"))
    return first.join(F.broadcast(plan), "sv_id").join(second, ["seq_idx", "sv_id"])


def allocated_variants(reference: DataFrame, wanted: dict[int, tuple[int, int]], seed: int = 1) -> DataFrame:
    """seq_idx, sv_id, sv_type, a_index, len, b_site: ``wanted`` variants (type: count, length) wherever a sequence has room, the first types first.

    A variant takes its length and one base more, and one base for what it puts elsewhere;
    it is left out only where no free stretch is left for one of the two.
    """
    plan = [(i, t, n) for i, (t, n) in enumerate((t, n) for t, (count, n) in wanted.items() for _ in range(count))]
    parts = [(i, t, n, 2 * i, n + 1) for i, t, n in plan] + [(i, t, n, 2 * i + 1, 1) for i, t, n in plan if t in ELSEWHERE]
    totals = reference.select("seq_idx", F.length("seq").cast("long").alias("total"))
    if 0 < len(parts) <= FEW:
        asked = sorted((rank, width) for *_, rank, width in parts)
        found = allocate_few(totals, asked, lambda key, rank, turn: numbers(key + seed, rank + turn * 1009, 12))
        at = {rank: F.get("starts", F.lit(i)) for i, (rank, _) in enumerate(asked)}
        each = [F.struct(F.lit(i).cast("long").alias("sv_id"), F.lit(t).cast("int").alias("sv_type"), at[2 * i].alias("a_index"), F.lit(n).cast("long").alias("len"), at[2 * i + 1 if t in ELSEWHERE else 2 * i].alias("b_site")) for i, t, n in plan]
        return found.select("seq_idx", F.explode(F.array(*each)).alias("v")).select("seq_idx", "v.*").where("a_index is not null and b_site is not null")
    kind = "sv_id bigint, sv_type int, len bigint, rank bigint, width bigint".split(", ")
    rows = F.array(*(F.struct(*(F.lit(v).cast(k.split()[1]).alias(k.split()[0]) for v, k in zip(part, kind))) for part in parts))
    requests = stored(reference.select("seq_idx", F.explode(rows).alias("r")).select("seq_idx", "r.*"), "variant-requests")
    number = lambda turn: draw(F.col("seq_idx") + seed, F.col("rank") + turn * 1009, 12)
    placed = requests.join(allocate(totals, requests, ["seq_idx"], number).drop("width"), ["seq_idx", "rank"])
    own, other = placed.where("rank % 2 = 0"), placed.where("rank % 2 = 1").select("seq_idx", "sv_id", F.col("start").alias("b_site"))
    both = own.join(other, ["seq_idx", "sv_id"], "left").where(~F.col("sv_type").isin(*ELSEWHERE) | F.col("b_site").isNotNull())
    return both.select("seq_idx", "sv_id", "sv_type", F.col("start").alias("a_index"), "len", F.coalesce("b_site", "start").alias("b_site"))


def variant_edits(variants: DataFrame, reference: DataFrame, times: int = 2, seed: int = 1) -> DataFrame:
    """seq_idx, sv_id, sv_type, kind (INSERT or EXCHANGE), start, len, str_value: what each variant does to the reference.

    An INSERT puts its string before ``start``; an EXCHANGE puts it in the place of ``len``
    bases.  Deleted bases are exchanged for nothing.
    """
    joined = variants.join(reference.select("seq_idx", "seq"), "seq_idx").withColumn("part", F.expr("substr(seq, cast(a_index + 1 as int), cast(len as int))"))
    noise = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("len") - 1), lambda p: base_of(F.shiftright(draw(F.col("seq_idx") * 31 + F.col("sv_id") + seed, p, 10), 8))), "")
    turned = F.translate(F.reverse("part"), "ACGTacgt", "TGCAtgca")
    fresh = F.array_join(F.transform(F.split("part", ""), lambda c, i: other_base(c, F.shiftright(draw(F.col("seq_idx") * 31 + F.col("sv_id") + seed, i.cast("long"), 11), 8))), "")
    t, a, b, n = F.col("sv_type"), F.col("a_index"), F.col("b_site"), F.col("len")
    edit = lambda kind, start, length, value: F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), length.cast("long").alias("len"), value.alias("str_value"))
    none, zero = F.lit(""), F.lit(0)
    edits = (
        F.when(t.isin(SMALL_INSERT, BIG_INSERT), F.array(edit("INSERT", a, zero, noise)))
        .when(t.isin(SMALL_DELETE, BIG_DELETE), F.array(edit("EXCHANGE", a, n, none)))
        .when(t == SMALL_SUBSTITUTE, F.array(edit("EXCHANGE", a, n, fresh)))
        .when(t == TANDEM, F.array(edit("INSERT", a + n, zero, F.repeat(F.col("part"), times - 1))))
        .when(t == DISPERSED, F.array(edit("INSERT", b, zero, F.col("part"))))
        .when(t == INVERTED_DUPLICATION, F.array(edit("INSERT", b, zero, turned)))
        .when(t == TRANSLOCATION, F.array(edit("EXCHANGE", a, n, none), edit("INSERT", b, zero, F.col("part"))))
        .when(t == INVERSION, F.array(edit("EXCHANGE", a, n, turned)))
        .when(t == INVERTED_TRANSLOCATION, F.array(edit("EXCHANGE", a, n, none), edit("INSERT", b, zero, turned)))
    )
    return joined.select("seq_idx", "sv_id", "sv_type", F.explode(edits).alias("e")).select("seq_idx", "sv_id", "sv_type", "e.*")


def apply_edits(reference: DataFrame, edits: DataFrame) -> DataFrame:
    """seq_idx, seq: the reference with disjoint edits applied, chunk by chunk."""
    return splice(reference, edits, keys=("seq_idx",))


def liftover(points: DataFrame, edits: DataFrame) -> DataFrame:
    """seq_idx, pos, lifted: where a reference position lies after the edits; a deleted one lies where its remainder would.

    lifted = pos - bases removed before pos + bases inserted at or before pos.  Edits are
    disjoint, so all that begin before a place lie wholly before it but the last exchange:
    a running sum over edits and places together, corrected by that exchange.
    """
    n, at = F.length("str_value"), F.col("start")
    e = edits.select("seq_idx", at.alias("pos"), F.when(F.col("kind") == "INSERT", 0).otherwise(2).alias("_order"), (n - F.col("len")).cast("long").alias("_shift"), F.when(F.col("kind") == "EXCHANGE", F.struct(at.alias("start"), F.col("len").cast("long").alias("len"), n.cast("long").alias("add"))).alias("_last"))
    p = points.select("seq_idx", "pos").distinct().select("seq_idx", "pos", F.lit(1).alias("_order"), F.lit(0).cast("long").alias("_shift"), F.lit(None).cast(e.schema["_last"].dataType).alias("_last"))
    so_far = Window.partitionBy("seq_idx").orderBy("pos", "_order").rowsBetween(Window.unboundedPreceding, 0)
    summed = e.unionByName(p).withColumn("_sum", F.sum("_shift").over(so_far)).withColumn("_in", F.last("_last", ignorenulls=True).over(so_far)).where("_order = 1")
    gone = F.col("pos") - F.col("_in.start")
    partly = F.when(gone < F.col("_in.len"), F.least(F.col("_in.add"), gone) - gone - (F.col("_in.add") - F.col("_in.len"))).otherwise(0)
    return summed.select("seq_idx", "pos", (F.col("pos") + F.col("_sum") + F.coalesce(partly, F.lit(0))).alias("lifted"))


def reportable(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("sv_type") > REPORTABLE_ABOVE)


def variants_by_rate(reference: DataFrame, rates: dict[int, tuple[float, int]], seed: int = 1) -> DataFrame:
    """seq_idx, sv_id, sv_type, a_index, len, b_site: each position draws for every type of ``rates`` (type: chance, length) in turn.

    The first type drawn at a position counts.  An event takes its length and one base, twice
    that where it puts something elsewhere (behind its own part); from the left, it is placed
    where the last placed one does not reach it and the sequence has room.  The walk begins
    anew wherever no earlier event reaches, so it goes over a few events at a time.
    """
    found = hits(reference.select("seq_idx", F.length("seq").alias("total")), [(purpose, int(chance * 2**31)) for purpose, (chance, _) in enumerate(rates.values(), 20)], seed)
    of = lambda values, kind: F.element_at(F.array(*map(F.lit, values)), (F.col("nth") + 1).cast("int")).cast(kind)
    drawn = found.select("seq_idx", "total", "pos", of(rates, "int").alias("sv_type"), of([n for _, n in rates.values()], "long").alias("len"))
    wide = (F.col("len") + 1) * F.when(F.col("sv_type").isin(*ELSEWHERE), 2).otherwise(1)
    room = drawn.withColumn("stop", F.col("pos") + wide).where("stop <= total")
    order = Window.partitionBy("seq_idx").orderBy("pos")
    reached = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    islands = room.withColumn("_free", (F.col("pos") >= reached).cast("long")).withColumn("_island", F.sum("_free").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kind = "struct<reached: bigint, kept: array<struct<pos: bigint, sv_type: int, len: bigint, stop: bigint>>>"
    start = F.expr(f"cast(named_struct('reached', 0L, 'kept', array()) as {kind})")
    events = islands.groupBy("seq_idx", "_island").agg(F.array_sort(F.collect_list(F.struct("pos", "sv_type", "len", "stop"))).alias("e"))
    walk = F.aggregate("e", start, lambda s, x: F.when(x["pos"] < s["reached"], s).otherwise(F.struct(x["stop"].alias("reached"), F.concat(s["kept"], F.array(x)).alias("kept")).cast(kind)))
    placed = events.select("seq_idx", F.explode(walk["kept"]).alias("e")).select("seq_idx", "e.*")
    number = (F.row_number().over(order) - 1).cast("long")
    return placed.select("seq_idx", number.alias("sv_id"), "sv_type", F.col("pos").alias("a_index"), "len", (F.col("pos") + F.col("len") + 1).alias("b_site"))


def _put(variants: DataFrame, edits: DataFrame, reference: DataFrame) -> DataFrame:
    """What reported variants put in: seq_idx, sv_id, sv_type, a_index, a_len, str_value, seq, sim and b, its place in the simulated sequence."""
    simulated = apply_edits(reference, edits).withColumnRenamed("seq", "sim")
    put = edits.where((F.col("sv_type") > REPORTABLE_ABOVE) & (F.col("str_value") != ""))
    lifted = liftover(put.select("seq_idx", F.col("start").alias("pos")).distinct(), edits).withColumnRenamed("pos", "start")
    at = F.col("lifted") - F.when(F.col("kind") == "INSERT", F.length("str_value")).otherwise(0)
    return put.join(lifted, ["seq_idx", "start"]).withColumn("b", at).join(variants.select("seq_idx", "sv_id", "a_index", F.col("len").alias("a_len")), ["seq_idx", "sv_id"]).join(reference.select("seq_idx", "seq"), "seq_idx").join(simulated, "seq_idx")


def _three_rows() -> Column:
    """The reference segment, the segment found in the simulated sequence, and the string expected there; inverted ones are on the minus strand, starts counted from its end."""
    n, minus, size = F.length("str_value"), F.col("sv_type").isin(*INVERTED), F.length("sim")
    start = F.when(minus, size - F.col("b") - n).otherwise(F.col("b"))
    line = lambda name, s, length, strand, total, seq: F.struct(F.lit(name).alias("name"), s.cast("long").alias("start"), length.cast("long").alias("len"), strand.alias("strand"), total.cast("long").alias("src_size"), seq.alias("seq"))
    strand = F.when(minus, "-").otherwise("+")
    return F.array(
        line("reference", F.col("a_index"), F.col("a_len"), F.lit("+"), F.length("seq"), F.expr("substr(seq, cast(a_index + 1 as int), cast(a_len as int))")),
        line("simulated", start, n, strand, size, F.expr("substr(sim, cast(b + 1 as int), length(str_value))")),
        line("expected", start, n, strand, size, F.col("str_value")),
    )


def truth_rows(variants: DataFrame, edits: DataFrame, reference: DataFrame) -> DataFrame:
    """seq_idx, sv_id, row_ord, name, start, len, strand, src_size, seq: three rows for each reported variant that puts in bases."""
    return _put(variants, edits, reference).select("seq_idx", "sv_id", F.posexplode(_three_rows()).alias("row_ord", "r")).select("seq_idx", "sv_id", "row_ord", "r.*")


def truth_blocks(variants: DataFrame, edits: DataFrame, reference: DataFrame) -> DataFrame:
    """seq_idx, ord, sv_id, copy, row_ord, name, start, len, strand, src_size, seq: three rows for each copy that a reported variant puts in.

    Several copies in a row are blocks of their own.  Blocks are ordered by their places in
    the simulated sequence and then, which leaves that order among equals, by those in the reference.
    """
    put = _put(variants, edits, reference)
    copies = F.when(F.col("sv_type") == TANDEM, F.expr("length(str_value) div a_len")).otherwise(1)
    each = put.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    one = F.expr("cast(length(str_value) div " + f"(case when sv_type = {TANDEM} then length(str_value) div a_len else 1 end) as int)")
    cut = each.withColumn("_n", one).withColumn("b", F.col("b") + F.col("copy") * F.col("_n")).withColumn("str_value", F.expr("substr(str_value, cast(copy * _n + 1 as int), _n)"))
    order = F.row_number().over(Window.partitionBy("seq_idx").orderBy("a_index", "b", "sv_id")) - 1
    return cut.withColumn("ord", order.cast("long")).select("seq_idx", "ord", "sv_id", "copy", F.posexplode(_three_rows()).alias("row_ord", "r")).select("seq_idx", "ord", "sv_id", "copy", "row_ord", "r.*")
