"""Signature input of a sale: a status word or a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callytics.functions.text import normalize_code

# Status words and the two accepted date layouts.
IMMEDIATE, UNDERWRITING, DATED = "IMM", "UW", "DATE"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
DAY_FIRST = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"


def parse_signature(df: DataFrame, source: str) -> DataFrame:
    """Add signature_status, signature_date and followup_code; the status is null when refused.

    Each step is a column of its own, so that none is worked out twice.
    """
    value = F.col("_value")
    day_first = F.concat_ws(
        "-",
        F.regexp_extract(value, DAY_FIRST, 3),
        F.lpad(F.regexp_extract(value, DAY_FIRST, 2), 2, "0"),
        F.lpad(F.regexp_extract(value, DAY_FIRST, 1), 2, "0"),
    )
    date = F.when(value.rlike(ISO_DATE), value).when(value.rlike(DAY_FIRST), day_first)
    return (
        df.withColumn("_value", normalize_code(F.col(source)))
        .withColumns(
            {
                "followup_code": F.when(value.isin(IMMEDIATE, UNDERWRITING), value),
                "signature_date": date.try_cast("date"),
            }
        )
        .withColumn(
            "signature_status",
            F.coalesce("followup_code", F.when(F.col("signature_date").isNotNull(), F.lit(DATED))),
        )
        .drop("_value")
    )
