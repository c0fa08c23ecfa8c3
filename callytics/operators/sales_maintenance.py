"""Updates, deletes and reloads of stored sales. Each returns the changed table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from callytics.functions.money import with_cents
from callytics.functions.signature import parse_signature
from callytics.functions.text import is_blank, normalize_code, strip
from callytics.functions.time import Instant, instant
from callytics.operators.catalog import catalog_upsert
from callytics.operators.sales_ingest import resolve_catalog
from callytics.plans.lineage import cut
from callytics.sources.schemas import BILLING_PERIODS
from callytics.sources.tables import load_periods, replace_periods, with_period

# Fixed value: the notes of sales that a reload replaces.
RELOAD_TAG = "mock_dashboard_seed"

_FIELDS = [
    "company_code",
    "product_code",
    "client_name",
    "amount_cents",
    "currency",
    "billing_period",
    "signature",
    "sold_at",
]


class Updated(NamedTuple):
    sales: DataFrame
    missing: DataFrame
    rejected: DataFrame
    companies: DataFrame
    products: DataFrame


def _judged_patches(patches: DataFrame) -> DataFrame:
    """Patches with parsed fields and the code of the first rule they fail; null = not supplied."""
    texts = ["company_code", "product_code", "client_name", "amount", "currency", "billing_period", "signature_input", "notes"]
    seq = F.col("seq").cast("long") if "seq" in patches.columns else F.lit(0).cast("long")
    # An empty text is no value; notes may be empty, and an empty amount is a wrong one.
    given = [F.col(c).cast("string") for c in texts if c not in ("amount", "notes")]
    empty = F.exists(F.array(*given), lambda v: F.coalesce(v == "", F.lit(False)))
    parsed = parse_signature(with_cents(patches, "amount", "amount_cents"), "signature_input")
    given = parsed.select(
        "id",
        "patched_at",
        normalize_code(F.col("company_code")).alias("company_code"),
        normalize_code(F.col("product_code")).alias("product_code"),
        strip(F.col("client_name")).alias("client_name"),
        F.col("amount").isNotNull().alias("_priced"),
        "amount_cents",
        normalize_code(F.col("currency")).alias("currency"),
        "billing_period",
        (~is_blank(F.col("signature_input"))).alias("_signed"),
        F.struct("signature_status", "signature_date", "followup_code").alias("signature"),
        "sold_at",
        "notes",
        F.coalesce("notes_set", F.lit(False)).alias("notes_set"),
        # No two fields of patches at one instant come from different ones: the row itself breaks ties.
        F.struct("patched_at", seq.alias("seq"), F.xxhash64(*texts).alias("tie")).alias("_order"),
        empty.alias("_empty"),
    )
    error = (
        F.when(~F.col("billing_period").isin(*BILLING_PERIODS), "invalid_body")
        .when(F.col("_empty") | (F.col("currency") == ""), "invalid_body")
        .when(F.col("company_code") == "", "invalid_company")
        .when(F.col("product_code") == "", "invalid_product")
        .when(F.col("_signed") & F.col("signature.signature_status").isNull(), "invalid_signature_input")
        .when(F.col("_priced") & F.col("amount_cents").isNull(), "invalid_amount")
        .when(F.col("client_name") == "", "invalid_client_name")
    )
    signature = F.when(F.col("_signed"), F.col("signature"))
    # A generator output, so that filters on it do not repeat the rules.
    return given.select("*", F.explode_outer(F.array(error)).alias("error")).withColumn("signature", signature)


def rejected_patches(patches: DataFrame) -> DataFrame:
    """(id, patched_at, error) of the patches that break a rule."""
    return _judged_patches(patches).filter(F.col("error").isNotNull()).select("id", "patched_at", "error")


def missing_patches(sales: DataFrame, patches: DataFrame) -> DataFrame:
    """Ids of patches that match no sale."""
    return patches.select("id").distinct().join(sales.select("id"), "id", "left_anti")


def _merged(patches: DataFrame) -> DataFrame:
    """All patches of a sale as one: each field from the last patch that supplies it."""
    last = [
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_order"))).alias(f"_{f}") for f in _FIELDS
    ]
    noted = F.when(F.col("notes_set"), F.col("_order"))
    notes = F.max_by(F.struct("notes"), noted).alias("_note")
    return patches.groupBy("id").agg(*last, notes, F.max("notes_set").alias("_noted"))


def sales_update(
    sales: DataFrame, patches: DataFrame, companies: DataFrame, products: DataFrame, now: Instant
) -> Updated:
    """Apply partial updates by id.

    `patches`: id, patched_at, company_code, product_code, client_name, amount, currency,
    billing_period, signature_input, sold_at, notes, notes_set, and `seq` where several can have one
    time. Null fields keep the stored value, empty ones are refused; notes are replaced, also by null, when
    `notes_set` is true. Of patches at one time without `seq` one, the same for all fields, counts as the last.
    """
    missing, rejected = missing_patches(sales, patches), rejected_patches(patches)
    merged = _merged(_judged_patches(patches).filter(F.col("error").isNull()))

    company = companies.select(F.col("id").alias("company_id"), F.col("code").alias("_company_now"))
    product = products.select(F.col("id").alias("product_id"), F.col("code").alias("_product_now"))
    found = (
        merged.join(sales.select("id", "company_id", "product_id"), "id")
        .join(company, "company_id")
        .join(product, "product_id")
        .drop("company_id", "product_id")
        .withColumn("company_code", F.coalesce("_company_code", "_company_now"))
        .withColumn("product_code", F.coalesce("_product_code", "_product_now"))
    )
    found = cut(found, "patches")
    companies_now, products_now = catalog_upsert(companies, products, found)
    resolved = resolve_catalog(found, companies_now, products_now).select(
        "id",
        F.lit(True).alias("_patched"),
        F.col("company_id").alias("_company_id"),
        F.col("product_id").alias("_product_id"),
        *[f"_{f}" for f in _FIELDS if not f.endswith("_code")],
        "_note",
        "_noted",
    )

    signed = F.col("_signature").isNotNull()
    changes = {
        "company_id": F.coalesce("_company_id", "company_id"),
        "product_id": F.coalesce("_product_id", "product_id"),
        "client_name": F.coalesce("_client_name", "client_name"),
        "amount_cents": F.coalesce("_amount_cents", "amount_cents"),
        "currency": F.coalesce("_currency", "currency"),
        "billing_period": F.coalesce("_billing_period", "billing_period"),
        "signature_status": F.when(signed, F.col("_signature.signature_status")).otherwise(F.col("signature_status")),
        "signature_date": F.when(signed, F.col("_signature.signature_date")).otherwise(F.col("signature_date")),
        "followup_code": F.when(signed, F.col("_signature.followup_code")).otherwise(F.col("followup_code")),
        "sold_at": F.coalesce("_sold_at", "sold_at"),
        "notes": F.when(F.col("_noted"), F.col("_note.notes")).otherwise(F.col("notes")),
        "updated_at": F.when(F.col("_patched"), instant(now)).otherwise(F.col("updated_at")),
    }
    updated = sales.join(resolved, "id", "left").withColumns(changes).select(*sales.columns)
    return Updated(updated, missing, rejected, companies_now, products_now)


def sales_delete(sales: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining sales, ids that matched none)."""
    wanted = ids.select("id").distinct()
    return sales.join(wanted, "id", "left_anti"), wanted.join(sales.select("id"), "id", "left_anti")


def sales_reload(sales: DataFrame, replacement: DataFrame, tag: str = RELOAD_TAG) -> DataFrame:
    """Replace the sales whose notes equal the tag."""
    kept = sales.filter(~F.coalesce(F.col("notes") == tag, F.lit(False)))
    return kept.unionByName(replacement.withColumn("notes", F.lit(tag)).select(*sales.columns))


def reload_stored(path: str, replacement: DataFrame, tag: str = RELOAD_TAG, every: str = "day") -> None:
    """`sales_reload` on sales stored by `write_periods`: only periods with replaced or new sales are read and rewritten."""
    spark = replacement.sparkSession
    stored = load_periods(spark, path, "sales")
    replaced = F.coalesce(F.col("notes") == tag, F.lit(False))
    new = with_period(replacement.withColumn("notes", F.lit(tag)), F.col("sold_at"), every).select(*stored.columns)
    touched = stored.filter(replaced).select("period").union(new.select("period")).distinct()
    kept = stored.filter(~replaced).join(touched, "period", "left_semi").select(*stored.columns)
    replace_periods(kept.unionByName(new), path, touched)


def delete_stored(path: str, ids: DataFrame) -> None:
    """`sales_delete` on sales stored by `write_periods`: only periods with deleted sales are rewritten."""
    stored = load_periods(ids.sparkSession, path, "sales")
    gone = ids.select("id").distinct()
    touched = stored.join(gone, "id", "left_semi").select("period").distinct()
    kept = stored.join(gone, "id", "left_anti").join(touched, "period", "left_semi").select(*stored.columns)
    replace_periods(kept, path, touched)
