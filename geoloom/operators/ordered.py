"""Ordered work over keys of any size.

A window over a key puts the whole key in one task. These helpers cut each key into blocks along its
order first, work per block, and carry one row per block across, so a key with a third of all rows is
spread like any other. The caller names the block: a non-decreasing function of the order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.session import roomy, settle

BLOCK = 4096


def block_row_number(df: DataFrame, keys: list[str], order: list, block: Column, out: str = "rn", known: int = 0) -> DataFrame:
    """1-based position of each row inside its key. ``order`` must be total.

    Only a crowded key, one of more than ``BLOCK`` rows, is cut into blocks; there is at most one for every ``BLOCK`` rows of
    the table, so their list is broadcast. All rows are shuffled once, and where no key is crowded nothing else is.
    ``known`` is the number of rows, or more, where the caller knows it; tasks follow it.
    """
    rows = df.withColumn("__at", F.coalesce(block.cast("long"), F.lit(-2 ** 63)))  # no block comes first, as nulls do
    if keys:
        crowded = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BLOCK).select(*keys, F.lit(True).alias("__crowd"))
        rows = rows.join(F.broadcast(crowded), keys, "left")
    else:
        rows = rows.withColumn("__crowd", F.lit(True))
    rows = rows.withColumn("__blk", F.when(F.col("__crowd"), F.col("__at")).otherwise(0)).drop("__at")
    sizes = rows.where("__crowd").groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, "__blk", F.sum("__size").over(before).alias("__base")).where("__base IS NOT NULL")
    local = F.row_number().over(Window.partitionBy(*keys, "__blk").orderBy(*order))
    return (roomy(rows.drop("__crowd"), [*keys, "__blk"], known).withColumn("__rn", local).join(base, [*keys, "__blk"], "left")
            .withColumn(out, (F.col("__rn") + F.coalesce("__base", F.lit(0))).cast("long")).drop("__blk", "__rn", "__base"))


def block_running(df: DataFrame, keys: list[str], order: list, block: Column, sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None,
                  inclusive: bool = False, dense: bool = True, later: Column | None = None) -> DataFrame:
    """Sums (as double, 0 before the first row) and largest values over the earlier rows of the key, and this one when inclusive.

    With ``dense`` the order counts places from 0, so only a crowded key has a block other than 0 and their list is broadcast; what
    came before a block is worked out for those keys alone, and all rows are shuffled once. ``later`` says the same as
    "in another block than 0" by columns that are known earlier, so that the search for crowded keys skips what lies between.
    """
    sums, tops = sums or {}, tops or {}
    values = {f"__v{i}": v for i, v in enumerate([*sums.values(), *tops.values()])}
    kinds = [*[F.sum] * len(sums), *[F.max] * len(tops)]
    rows = df.withColumns({"__blk": block.cast("long"), **values})
    cut = rows
    if keys and dense:
        cut = rows.join(F.broadcast(rows.where(F.col("__blk") != 0 if later is None else later).select(*keys).distinct()), keys, "left_semi")
    totals = cut.groupBy(*keys, "__blk").agg(*[kind(v).alias(v) for kind, v in zip(kinds, values)])
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "__blk", F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy("__blk")).alias("__later"),
                         *[kind(v).over(before).alias(f"__base{i}") for i, (kind, v) in enumerate(zip(kinds, values))]).where("__later = 1").drop("__later")
    frame = (Window.partitionBy(*keys, "__blk").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    rows = rows.withColumns({f"__run{i}": kind(v).over(frame) for i, (kind, v) in enumerate(zip(kinds, values))}).join(base, [*keys, "__blk"], "left")
    zero = F.lit(0).cast("double")
    out = {name: F.coalesce(F.col(f"__base{i}"), zero) + F.coalesce(F.col(f"__run{i}"), zero) for i, name in enumerate(sums)}
    out |= {name: F.greatest(f"__base{i}", f"__run{i}") for i, name in enumerate(tops, len(sums))}
    return rows.withColumns(out).drop("__blk", *values, *[f"__{k}{i}" for i in range(len(values)) for k in ("run", "base")])


def block_running_sum(df: DataFrame, keys: list[str], order: list, value: Column, block: Column,
                      out: str, inclusive: bool = False, dense: bool = True) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key (and this one when inclusive)."""
    return block_running(df, keys, order, block, {out: value}, None, inclusive, dense)


def pair_up(df: DataFrame, keys: list[str], idx: str, values: list[str], size: str | None = None, known: int = 0) -> DataFrame:
    """Consecutive rows of each key side by side: columns v0 and v1 for every value v.

    A key is cut into blocks of places, and the first row of a block is lent to the block before, so each row is
    shuffled once and no task holds a key. ``size`` names the column with the key's row count when the last row pairs with the
    first (closed rings); without it lines stay open. A place that comes twice is an error, since no order could tell
    which of the two rows is meant. ``known`` is the number of rows, or more, where the caller knows it; tasks follow it.
    """
    place = F.col(idx).cast("long")
    seat = lambda at, block: F.struct(at.alias("at"), block.cast("long").alias("blk"))
    block = lambda at: F.floor(at / BLOCK)
    seats = [seat(place, block(place)), F.when((place > 0) & (place % BLOCK == 0), seat(place, block(place) - 1))]
    if size is not None:
        n = F.col(size).cast("long")
        seats.append(F.when(place == 0, seat(n, block(n - 1))))
    rows = df.select(*keys, *values, F.explode(F.array_compact(F.array(*seats))).alias("_s")).select(*keys, *values, "_s.at", "_s.blk")
    rows = roomy(rows, [*keys, "blk"], known)
    w = Window.partitionBy(*keys, "blk").orderBy("at")
    out = rows.select(*keys, F.col("at").alias(idx), "blk", F.lead("at").over(w).alias("_next"), *[F.col(v).alias(f"{v}0") for v in values],
                      *[F.lead(v).over(w).alias(f"{v}1") for v in values])
    fault = F.raise_error(F.concat(F.lit("a place comes twice in a line, at "), F.col(idx).cast("string"))).cast("boolean")
    good = F.when(F.col("_next") == F.col(idx), fault).otherwise((F.col("_next") == F.col(idx) + 1) & (block(F.col(idx)) == F.col("blk")))
    return out.where(good).drop("blk", "_next")


def rank_links(links: DataFrame, keys: list[str], longest: int, doubled: int = 256) -> DataFrame:
    """Order linked rows: arc, ``low`` (the smallest arc reachable, itself included), ``tail`` (the last arc; null on a cycle), ``hops`` to it.

    ``links`` has the keys, ``arc`` and ``nxt`` (null at an end). Lists of up to ``doubled`` rows take log2(longest) joins of all arcs
    with all arcs; longer ones are contracted, whose joins together move a few times the arcs however long the lists are.
    Both give the same rows.
    """
    return _double(links, keys, longest) if longest <= doubled else _contract(links, keys)


def _double(links: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Pointer doubling: each round is one join on unique arcs, so neither long chains nor hot groups gather.

    Arcs that neither lead on nor are led to are lines of their own and take no part in the rounds.
    """
    led, ends = links.where("nxt IS NOT NULL"), links.where("nxt IS NULL")
    to = led.select(*keys, F.col("nxt").alias("arc"))
    arc = F.col("arc")
    lone = settle(ends.join(to, [*keys, "arc"], "left_anti").select(*keys, "arc", arc.alias("low"), arc.alias("tail"), F.lit(0).cast("long").alias("hops")))
    links = settle(led.select(*keys, "arc", "nxt").unionByName(ends.join(to, [*keys, "arc"], "left_semi").select(*keys, "arc", "nxt")))
    state = links.select(*keys, "arc", "nxt", F.col("arc").alias("low"), F.col("arc").alias("tail"),
                         F.lit(0).cast("long").alias("hops"))
    rounds = max(1, math.ceil(math.log2(max(2, longest + 1))))
    for step in range(rounds):
        ahead = state.select(*keys, F.col("arc").alias("nxt"), F.col("nxt").alias("_n"), F.col("low").alias("_l"),
                             F.col("tail").alias("_t"), F.col("hops").alias("_h"))
        state = state.join(ahead, [*keys, "nxt"], "left").select(
            *keys, "arc", F.col("_n").alias("nxt"), F.least("low", "_l").alias("low"),
            F.coalesce("_t", "tail").alias("tail"),
            (F.col("hops") + F.when(F.col("_t").isNotNull(), F.col("_h") + 1).otherwise(0)).alias("hops"))
        if step % 4 == 3 or step == rounds - 1:
            state = settle(state)
    return state.withColumn("tail", F.when(F.col("nxt").isNull(), F.col("tail"))).drop("nxt").unionByName(lone)


def _contract(links: DataFrame, keys: list[str]) -> DataFrame:
    """List ranking by contraction.

    In each round a hash gives every arc heads or tails, and an arc with tails whose predecessor has heads is spliced out: about a quarter of
    all. Lists that are down to one arc leave, cycles as an arc that follows itself. Then the spliced arcs are put back
    in reverse order, each from the arc it was followed by.
    """
    state = settle(links.select(*keys, "arc", "nxt", F.lit(1).cast("long").alias("hops"), F.col("arc").alias("low")))
    columns, rounds, finished = [*keys, "arc", "nxt", "hops", "low"], [], None
    while not state.isEmpty():
        tails = lambda c: F.pmod(F.xxhash64(*keys, F.col(c), F.lit(len(rounds))), F.lit(2)) == 1  # noqa: E731, B023
        goes_on = F.col("nxt").isNotNull() & (F.col("nxt") != F.col("arc"))
        before = state.where(goes_on).select(*keys, F.col("nxt").alias("arc"), F.col("arc").alias("_arc"), F.col("hops").alias("_hops"), F.col("low").alias("_low"))
        spliced = F.coalesce(~tails("_arc") & tails("arc"), F.lit(False))
        splices = F.coalesce(goes_on & ~tails("arc") & tails("nxt"), F.lit(False))
        fate = F.when(F.col("_arc").isNull() & ~goes_on, "done").when(spliced, "out").when(splices, "changed").otherwise("stays")
        met = settle(state.join(before, [*keys, "arc"], "left").withColumn("_fate", fate))
        alone = met.where("_fate = 'done'").select(*columns)
        finished = alone if finished is None else finished.unionByName(alone)
        out = met.where("_fate = 'out'")
        rounds.append(out.select(*columns))
        state = met.where("_fate = 'stays'").select(*columns).unionByName(out.select(
            *keys, F.col("_arc").alias("arc"), "nxt", (F.col("_hops") + F.col("hops")).alias("hops"), F.least("_low", "low").alias("low")))
    if finished is None:
        return links.select(*keys, "arc", F.col("arc").alias("low"), F.col("arc").alias("tail"), F.lit(0).cast("long").alias("hops"))
    end = F.col("nxt").isNull()
    done = settle(finished.select(*keys, "arc", "low", F.when(end, F.col("arc")).alias("tail"), F.lit(0).cast("long").alias("hops")))
    for out in reversed(rounds):
        ahead = done.select(*keys, F.col("arc").alias("nxt"), F.col("low").alias("_low"), F.col("tail").alias("_tail"), F.col("hops").alias("_hops"))
        back = out.join(ahead, [*keys, "nxt"], "left").select(
            *keys, "arc", F.least("low", "_low").alias("low"), F.when(end, F.col("arc")).otherwise(F.col("_tail")).alias("tail"),
            F.when(end, F.lit(0)).otherwise(F.col("hops") + F.col("_hops")).cast("long").alias("hops"))
        done = done.unionByName(settle(back))
    return done


def top_per_key(df: DataFrame, keys: list[str], order: list, limit: int, out: str, salts: int = 256) -> DataFrame:
    """The first ``limit`` rows of each key with their place, for keys of any size.

    Each key is cut into salted parts that keep their own first rows; only those meet again, so the last
    window of a key sees at most salts * limit rows.
    """
    plain = [f.dataType for f in df.schema.fields]
    cols = [c for c, t in zip(df.columns, plain) if t.typeName() != "map"]
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    first = (df.withColumn("__salt", F.pmod(F.hash(*cols), F.lit(salts))).withColumn("__r", F.row_number().over(part))
             .where(F.col("__r") <= limit).drop("__salt", "__r"))
    return first.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= limit)


def global_row_number(df: DataFrame, order: list, out: str) -> DataFrame:
    """1-based place of each row in the whole table. ``order`` must be total.

    The table is laid out in ranges of the order; each range is numbered alone and starts after the counts of
    those before it, so no task sees more than one range (and one row for each range).
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__rn", inside).join(base, "__p").withColumn(out, (F.col("__rn") + F.col("__base")).cast("long")).drop("__p", "__rn", "__base")


def first_rows(df: DataFrame, order: list, limit: int) -> tuple[DataFrame, DataFrame]:
    """(first ``limit`` rows, the rows left out) of a whole table, where a cap is asked for. ``order`` must be total."""
    placed = settle(global_row_number(df, order, "__place"))
    return placed.where(F.col("__place") <= limit).drop("__place"), placed.where(F.col("__place") > limit).drop("__place")
