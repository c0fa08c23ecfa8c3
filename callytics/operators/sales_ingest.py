"""From raw sale requests to stored sales."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from callytics.functions.money import with_cents
from callytics.functions.signature import parse_signature
from callytics.functions.text import is_blank, normalize_code, strip
from callytics.functions.time import Instant, instant
from callytics.operators.catalog import catalog_upsert
from callytics.plans.lineage import cut
from callytics.sources.schemas import BILLING_PERIODS

# Defaults and the accepted layout of a sale time.
DEFAULT_CURRENCY, DEFAULT_PERIOD = "USD", "month"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"

_REQUIRED = ["agent_id", "agent_name", "company_code", "product_code", "client_name", "signature_input"]
_NOT_EMPTY = [
    "discord_interaction_id",
    "discord_message_id",
    "discord_guild_id",
    "discord_channel_id",
    "currency",
]


def sale_time(text: Column) -> Column:
    """ISO time with offset; null for anything else."""
    return F.when(text.rlike(ISO_TIME), text.try_cast("timestamp"))


def sales_signature(raw: DataFrame) -> DataFrame:
    """The signature fields of raw sales and whether the input was understood."""
    parsed = parse_signature(raw.select("id", "signature_input"), "signature_input")
    return parsed.withColumn("understood", F.col("signature_status").isNotNull())


def _judged(raw: DataFrame) -> DataFrame:
    """All derived fields and `error`, the code of the first rule a row fails."""
    malformed = F.lit(False)
    for name in _REQUIRED:
        malformed = malformed | is_blank(F.col(name))
    for name in _NOT_EMPTY:
        malformed = malformed | F.coalesce(F.col(name) == "", F.lit(False))
    malformed = malformed | ~F.coalesce("billing_period", F.lit(DEFAULT_PERIOD)).isin(*BILLING_PERIODS)
    malformed = malformed | (F.col("sold_at").isNotNull() & F.col("_sold_at").isNull())

    derived = raw.withColumns(
        {
            "_sold_at": sale_time(F.col("sold_at")),
            "_company": normalize_code(F.col("company_code")),
            "_product": normalize_code(F.col("product_code")),
            "_client": strip(F.col("client_name")),
        }
    )
    derived = parse_signature(with_cents(derived, "amount", "amount_cents"), "signature_input")
    error = (
        F.when(malformed, "invalid_body")
        .when(F.col("amount_cents").isNull(), "invalid_amount")
        .when(F.col("signature_status").isNull(), "invalid_signature_input")
        .when(F.col("_company") == "", "invalid_company")
        .when(F.col("_product") == "", "invalid_product")
        .when(F.col("_client") == "", "invalid_client_name")
    )
    # As the output of a generator the error is a finished value: a filter on it does not make
    # Spark work out all rules a second time.
    return derived.select("*", F.explode_outer(F.array(error)).alias("error"))


def sales_ingest(raw: DataFrame, now: Instant) -> tuple[DataFrame, DataFrame]:
    """Split raw sales into (accepted, rejected). `id` is the arrival number of a row."""
    judged = _judged(raw)
    return _accepted(judged, now), _rejected(judged, raw.columns)


def _rejected(judged: DataFrame, columns: Sequence[str]) -> DataFrame:
    return judged.filter(F.col("error").isNotNull()).select(*columns, "error")


def _accepted(judged: DataFrame, now: Instant) -> DataFrame:
    return judged.filter(F.col("error").isNull()).select(
        "id",
        "discord_interaction_id",
        "discord_message_id",
        "discord_guild_id",
        "discord_channel_id",
        "agent_id",
        strip(F.col("agent_name")).alias("agent_name"),
        F.col("_company").alias("company_code"),
        F.col("_product").alias("product_code"),
        F.col("_client").alias("client_name"),
        "amount_cents",
        normalize_code(F.coalesce("currency", F.lit(DEFAULT_CURRENCY))).alias("currency"),
        F.coalesce("billing_period", F.lit(DEFAULT_PERIOD)).alias("billing_period"),
        "signature_status",
        "signature_date",
        "followup_code",
        "raw_text",
        "notes",
        F.coalesce("_sold_at", instant(now)).alias("sold_at"),
        instant(now).alias("created_at"),
        instant(now).alias("updated_at"),
    )


def sales_dedup(new: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split into (kept, duplicates) by message id; the first arrival is kept.

    The first id per message is found by a pre-aggregated group-by and joined back
    on the unique row id, so a message id repeated millions of times does no harm.
    """
    message = "discord_message_id"
    firsts = new.filter(F.col(message).isNotNull()).groupBy(message).agg(F.min("id").alias("id"))
    if stored is not None:
        known = stored.select(message).filter(F.col(message).isNotNull())
        firsts = firsts.join(known, message, "left_anti")
    marked = new.join(firsts.select("id", F.lit(True).alias("_first")), "id", "left")
    keep = F.col(message).isNull() | F.coalesce("_first", F.lit(False))
    return marked.filter(keep).select(*new.columns), marked.filter(~keep).select(*new.columns)


def resolve_catalog(sales: DataFrame, companies: DataFrame, products: DataFrame) -> DataFrame:
    """Replace company and product codes by ids."""
    company = companies.select(F.col("id").alias("company_id"), F.col("code").alias("company_code"))
    product = products.select(
        F.col("id").alias("product_id"), "company_id", F.col("code").alias("product_code")
    )
    return sales.join(company, "company_code").join(product, ["company_id", "product_code"])


class Recorded(NamedTuple):
    sales: DataFrame
    duplicates: DataFrame
    rejected: DataFrame
    companies: DataFrame
    products: DataFrame


def record_sales(
    raw: DataFrame,
    companies: DataFrame,
    products: DataFrame,
    now: Instant,
    stored: DataFrame | None = None,
) -> Recorded:
    """Validate, deduplicate and resolve one batch; accepted codes join the catalogue.

    The judged batch is written out once, as all five results are taken from it.
    """
    judged = cut(_judged(raw), "judged")
    accepted, rejected = _accepted(judged, now), _rejected(judged, raw.columns)
    companies_now, products_now = catalog_upsert(companies, products, accepted)
    kept, duplicates = sales_dedup(accepted, stored)
    sales = resolve_catalog(kept, companies_now, products_now).drop("company_code", "product_code")
    return Recorded(sales, duplicates, rejected, companies_now, products_now)
