"""Money is whole cents in a long column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callytics.functions.text import strip

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def with_cents(df: DataFrame, amount: str, cents: str) -> DataFrame:
    """Add the cents of an amount given as text; null when it is refused.

    Each step is a column of its own, so that none is worked out twice.
    """
    return (
        df.withColumn("_text", strip(F.col(amount).cast("string")))
        .withColumn("_number", F.when(F.col("_text").rlike(_NUMBER), F.col("_text").try_cast("double")))
        .withColumn(cents, amount_to_cents(F.col("_number")))
        .drop("_text", "_number")
    )


def amount_to_cents(amount: Column) -> Column:
    """Finite positive amount to cents, halves up; null for every other amount."""
    scaled = amount * F.lit(100.0)
    whole = F.floor(scaled)
    cents = whole + F.when(scaled - whole >= 0.5, F.lit(1)).otherwise(F.lit(0))
    finite = (amount > 0) & (amount < F.lit(float("inf"))) & ~F.isnan(amount)
    return F.when(finite, cents.cast("long"))
