"""Joins of instants with intervals, without pairing every instant of a key with every interval.

`as_of` is for intervals of a key that don't overlap, such as the stages of a call. Both sides are put in order together
inside blocks of time, an interval also standing at the begin of each block it reaches into, so no key is sorted whole;
a block with very many rows is cut by position (`plans/slices.py`).

`stabbed` is for intervals that may overlap; the one that began last wins. Time is divided into blocks of 1, 2, 4, 8 ...
units. An interval is made up of at most two blocks of each size, and an instant lies in one block of each size. Of each
block only the last-begun interval is kept, so an instant meets one row per size and nothing is multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from callytics.plans import slices
from callytics.plans.slices import Spread

BLOCK = "_block"


def as_of(
    requests: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    block: int,
    spread: Spread = Spread(),
) -> DataFrame:
    """`requests` with the columns of the interval [start, end) that holds `at`, null where none does.

    `at`, `start` and `end` are whole numbers. An interval is repeated once per block, so `block` should be about as long
    as intervals are.
    """
    place = lambda c: F.floor(F.col(c) / block)
    gained = [c for c in intervals.columns if c not in keys]
    begun = intervals.filter("start < end").withColumn(BLOCK, F.explode(F.sequence(place("start"), F.floor((F.col("end") - 1) / block))))
    begun = begun.select(
        *keys, BLOCK, F.greatest("start", F.col(BLOCK) * block).alias("_at"), F.lit(0).alias("_side"), F.struct(*gained).alias("_found")
    )
    asked = requests.select(*keys, place(at).alias(BLOCK), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*requests.columns).alias("_asked"))
    keyed, order = [*keys, BLOCK], ["_at", "_side"]
    rows = slices.sliced(begun.unionByName(asked, allowMissingColumns=True), keyed, order, spread)
    hot, carry = slices.hot_only(rows), None
    if hot is not None:
        last = F.max(F.when(F.col("_side") == 0, F.struct("_at", "_found")))
        ends = hot.groupBy(*keyed, slices.SLICE).agg(F.min("_at").alias("_at"), last.alias("_last"))
        known = F.last("_last", ignorenulls=True).over(slices.before(slices.across(keyed)))
        carry = ends.withColumn("_known", known).filter("_known is not null").select(
            *keyed, slices.SLICE, "_at", F.lit(-1).alias("_side"), F.col("_known._found").alias("_found")
        )
    inside = slices.upto(slices.inside(rows, keyed, order))
    held = slices.with_carry(rows, carry).withColumn("_found", F.last("_found", ignorenulls=True).over(inside))
    held = held.filter("_side = 1").withColumn("_found", F.when(F.col("_at") < F.col("_found.end"), F.col("_found")))
    return held.select("_asked.*", *[F.col(f"_found.{c}").alias(c) for c in gained])


def stabbed(requests: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, levels: int) -> DataFrame:
    """`requests`, each row once, with the columns of the interval [start, end) that holds `at` and began last, else nulls.

    Of intervals that began together the one with the greatest other columns counts. `at`, `start` and `end` are whole
    numbers; an `end` of null is open. 2**`levels` units should be about the length of long intervals: longer ones are
    made up of more blocks of the largest size.
    """
    gained = [c for c in intervals.columns if c not in keys]
    after = requests.agg((F.max(at) + 1).alias("after")).scalar()  # nobody asks later
    span = intervals.withColumn("_after", after).withColumn("_end", F.least(F.coalesce("end", "_after"), "_after"))
    size = F.expr("shiftleft(1L, level)")
    low, high = F.ceil(F.col("start") / size), F.floor(F.col("_end") / size)
    pieces = (
        span.filter(F.col("start") < F.col("_end"))
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
        .withColumns({"_low": low, "_high": high})
        .filter("_low < _high")
    )
    ends = F.array_compact(F.array(F.when(F.col("_low") % 2 != 0, F.col("_low")), F.when(F.col("_high") % 2 != 0, F.col("_high") - 1)))
    whole = F.sequence(F.col("_low"), F.col("_high") - 1)
    blocks = pieces.withColumn(BLOCK, F.explode(F.when(F.col("level") < levels, ends).otherwise(whole)))
    winner = F.max(F.struct("start", *[c for c in gained if c != "start"]))
    kept = blocks.groupBy(*keys, "level", BLOCK).agg(winner.alias("_found"))
    asked = requests.withColumn("_row", F.struct(*requests.columns)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    asked = asked.select(*keys, "level", F.floor(F.col(at) / size).alias(BLOCK), "_row")
    met = asked.join(kept, [*keys, "level", BLOCK], "left")
    best = met.groupBy("_row").agg(F.max("_found").alias("_found"))
    return best.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in gained])
