"""Keyed tables: latest row, upsert, new ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. Reduced before the shuffle, so a hot key stays small."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*order, *rest)) if _orderable(df, rest) else F.max_by(
        F.struct(*order, *rest), F.struct(*order)
    )
    found = df.groupBy(*keys).agg(newest.alias("_newest"))
    return found.select(*keys, "_newest.*").select(*df.columns)


def _orderable(df: DataFrame, names: Sequence[str]) -> bool:
    return not any("map<" in df.schema[n].dataType.simpleString() for n in names)


def upsert(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    set_cols: Sequence[str],
    order_col: str,
) -> DataFrame:
    """Insert new keys, overwrite `set_cols` of known ones, keep all other columns."""
    wanted = latest_per_key(changes, keys, [order_col])
    inserted = [c for c in target.columns if c not in keys and c in wanted.columns]
    wanted = wanted.select(
        *[F.col(k).alias(f"_new_{k}") for k in keys],
        F.lit(True).alias("_new"),
        *[F.col(c).alias(f"_new_{c}") for c in inserted],
    )
    matched = [target[k] == wanted[f"_new_{k}"] for k in keys]
    joined = target.withColumn("_old", F.lit(True)).join(wanted, matched, "full_outer")
    out = []
    for name in target.columns:
        if name in keys:
            out.append(F.coalesce(F.col(name), F.col(f"_new_{name}")).alias(name))
        elif name not in inserted:
            out.append(F.col(name))
        elif name in set_cols:
            out.append(F.when(F.col("_new"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.when(F.col("_old"), F.col(name)).otherwise(F.col(f"_new_{name}")).alias(name))
    return joined.select(*out)


def with_new_ids(df: DataFrame, unique: Sequence[str], last_id: Column, buckets: int = 1024) -> DataFrame:
    """Fill null `id`s with unused ones above `last_id`, without a global sort.

    Rows are numbered inside hash buckets of their unique key and the buckets take turns,
    so ids are distinct but, like those of a database sequence, not without gaps.
    """
    bucket = F.pmod(F.xxhash64(*unique), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("_new", "_bucket").orderBy(*unique))
    fresh = last_id + (place - 1) * buckets + F.col("_bucket") + 1
    return (
        df.withColumns({"_new": F.col("id").isNull(), "_bucket": bucket})
        .withColumn("id", F.when(F.col("_new"), fresh).otherwise(F.col("id")))
        .drop("_new", "_bucket")
    )
