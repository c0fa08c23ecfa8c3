"""Pages and top-k. Spark keeps only offset + limit rows per task for these."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def clamp(value: int | str | None, low: int, high: int, default: int) -> int:
    """A limit inside [low, high]; the default when it does not begin with a whole number."""
    number = re.match(r"\s*[+-]?\d+", "" if value is None else str(value))
    return min(max(int(number[0]), low), high) if number else default


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(max(offset, 0)).limit(limit)


def with_total(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Add the row count of `counted`, computed as one aggregate."""
    total = counted.agg(F.count("*").alias("total"))
    return rows.withColumn("total", total.scalar())
