"""Ordered neighbours without putting all rows of a hot key into one task.

`lag` / `lead` over a window partitioned by an agent or a session sorts every row of that
key in one task. That is right for most keys and wrong for a hot one. Keys are counted
first (one column, reduced before the shuffle); without hot keys a window costs the one
shuffle it always costs, and nothing else is in the plan. The rows of hot keys are range
partitioned by key and order, into tasks whose number goes with the rows alone, and each task
cuts its rows into slices. So a key is cut by position, wherever its rows lie in time,
also if all have one instant. Each slice is reduced to its edge row before any shuffle,
the few edge rows are put in order, and each slice receives the edge row of its neighbour
as a carry row. The windows then run per (key, slice).

The result does not depend on which keys count as hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from callytics.plans.lineage import cut

SLICE = "_slice"
CARRY = "_carry"
HOT = "_hot"
ROW = "_row"

#: Numbers of `monotonically_increasing_id` that one task has.
TASK = 1 << 33

HOUR = 3_600
DAY = 86_400

#: Hot keys are broadcast up to this number; beyond it Spark joins as it sees fit.
BROADCAST_KEYS = 1_000_000

#: Rows of hot keys that one task cuts into slices, if slices are shorter.
TASK_ROWS = 100_000


@dataclass(frozen=True)
class Hot:
    """The hot keys, as a stored table or None, their number and the number of their rows."""

    keys: DataFrame | None = None
    count: int = 0
    rows: int = 0


@dataclass(frozen=True)
class Spread:
    """When a key is hot, and how many rows of a hot key stay together.

    `hot` gives the hot keys where they are known or cheaper to find from another table (a superset does no harm);
    see `with_hot`.
    """

    hot_rows: int = 2_000_000
    slice_rows: int = 500_000
    hot: Hot | None = None


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = Spread.hot_rows) -> Hot:
    """Keys with more than `hot_rows` rows: at most (number of rows / hot_rows) of them. One job."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    found = counted.agg(F.count("*").alias("keys"), F.sum("_n").alias("rows")).first()
    if not found["keys"]:
        return Hot()
    return Hot(cut(counted.select(*keys), "hot_keys"), found["keys"], found["rows"])


def with_hot(spread: Spread, df: DataFrame, keys: Sequence[str]) -> Spread:
    """The spread with its hot keys counted in `df`, to be counted once for several operators."""
    return spread if spread.hot else replace(spread, hot=hot_keys(df, keys, spread.hot_rows))


def time_slice(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def ms_slice(ms: Column, seconds: int) -> Column:
    return F.floor(ms / F.lit(seconds * 1000))


def parted(df: DataFrame, keys: Sequence[str], order: Sequence[str], spread: Spread) -> tuple[DataFrame, DataFrame | None]:
    """The rows of normal keys, and those of hot keys with their slice (stored), or None without hot keys."""
    hot = with_hot(spread, df, keys).hot
    if not hot.keys:
        return df, None
    # Proven size: a table of 2e12 rows has at most a million hot keys.
    listed = F.broadcast(hot.keys) if hot.count <= BROADCAST_KEYS else hot.keys
    normal = df.join(listed, list(keys), "left_anti")
    tasks = -(-hot.rows // max(spread.slice_rows, TASK_ROWS))
    ordered = df.join(listed, list(keys), "left_semi").repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    # Rows alike in key and order stand in one task, and stay in the slice of the first of them.
    first = F.min(ROW).over(Window.partitionBy(*keys, *order))
    placed = ordered.withColumn(ROW, F.monotonically_increasing_id()).withColumn(SLICE, first - first % TASK % spread.slice_rows)
    return normal, cut(placed.drop(ROW), "slices")


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], spread: Spread) -> DataFrame:
    """Add the carry column and, where there are hot keys, slice and hot columns. Slices of a key rise with its order."""
    normal, placed = parted(df, keys, order, spread)
    if placed is None:
        return df.withColumn(CARRY, F.lit(False))
    whole = normal.withColumns({SLICE: F.lit(-1).cast("long"), HOT: F.lit(False)})
    return whole.unionByName(placed.withColumn(HOT, F.lit(True))).withColumn(CARRY, F.lit(False))


def hot_only(rows: DataFrame) -> DataFrame | None:
    """The rows that need edges; None without hot keys."""
    return rows.filter(HOT) if HOT in rows.columns else None


def place(rows: DataFrame, keys: Sequence[str]) -> list[str]:
    """The columns that tell the slices of `rows`. Without hot keys they are the keys, so windows share one exchange."""
    return [*keys, SLICE] if HOT in rows.columns else [*keys]


def inside(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Rows of one slice of one key, in order."""
    return Window.partitionBy(*place(rows, keys)).orderBy(*order)


def across(keys: Sequence[str]) -> WindowSpec:
    """The slices of one key, in order; for edge rows only."""
    return Window.partitionBy(*keys).orderBy(SLICE)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_carry(rows: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Add carry rows, if any; columns they do not hold are null."""
    if carry is None:
        return rows
    return rows.unionByName(carry.withColumn(CARRY, F.lit(True)), allowMissingColumns=True)


def without_carry(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col(CARRY)).drop(SLICE, CARRY, HOT)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    spread: Spread,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add lag / lead columns, given as {new column: source column}.

    `order` must be total inside a key.
    """
    lag, lead = lag or {}, lead or {}
    rows = sliced(df, keys, order, spread)
    hot, carry = hot_only(rows), None
    if hot is not None:
        edge = F.struct(*dict.fromkeys([*order, *lag.values(), *lead.values()]))
        edges = hot.groupBy(*keys, SLICE).agg(F.max(edge).alias("_last"), F.min(edge).alias("_first"))
        neighbours = [F.lag("_last").over(across(keys))] if lag else []
        neighbours += [F.lead("_first").over(across(keys))] if lead else []
        carry = (
            edges.select(*keys, SLICE, F.array(*neighbours).alias("_edges"))
            .select(*keys, SLICE, F.explode("_edges").alias("_edge"))
            .filter(F.col("_edge").isNotNull())
            .select(*keys, SLICE, "_edge.*")
        )
    window = inside(rows, keys, order)
    found = {new: F.lag(source).over(window) for new, source in lag.items()}
    found |= {new: F.lead(source).over(window) for new, source in lead.items()}
    return without_carry(with_carry(rows, carry).withColumns(found))
