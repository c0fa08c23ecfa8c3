"""Dashboard queries over sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from callytics.functions.text import normalize_code
from callytics.functions.time import Instant, as_utc, check_range, instant
from callytics.plans.lineage import cut
from callytics.plans.paging import clamp, page

# Page limits.
PAGE_LIMIT, PAGE_DEFAULT = 500, 100


def sales_enriched(sales: DataFrame, companies: DataFrame, products: DataFrame) -> DataFrame:
    """Sales with company and product names; inactive ones included.

    No broadcast is forced: Spark broadcasts a catalogue only while it measures
    below its threshold, and splits hot join partitions of a larger one.
    """
    company = companies.select(
        F.col("id").alias("company_id"),
        F.col("code").alias("company_code"),
        F.col("name").alias("company_name"),
    )
    product = products.select(
        F.col("id").alias("product_id"),
        F.col("code").alias("product_code"),
        F.col("name").alias("product_name"),
    )
    return (
        sales.join(company, "company_id")
        .join(product, "product_id")
        .select(
            "id",
            "discord_interaction_id",
            "discord_message_id",
            "discord_guild_id",
            "discord_channel_id",
            "agent_id",
            "agent_name",
            "company_code",
            "company_name",
            "product_code",
            "product_name",
            "client_name",
            "amount_cents",
            "currency",
            "billing_period",
            "signature_status",
            "signature_date",
            "followup_code",
            "raw_text",
            "notes",
            "sold_at",
            "created_at",
            "updated_at",
        )
    )


def sale_by_id(enriched: DataFrame, sale_id: int) -> DataFrame:
    """One sale; no row means it was not found."""
    return enriched.filter(F.col("id") == sale_id)


def sales_filtered(
    enriched: DataFrame,
    start: Instant,
    end: Instant,
    company: str | None = None,
    product: str | None = None,
    agent: str | None = None,
) -> DataFrame:
    """Sales of the half-open range, optionally of one company, product or agent."""
    check_range(start, end)
    found = enriched.filter((F.col("sold_at") >= instant(start)) & (F.col("sold_at") < instant(end)))
    if company:
        found = found.filter(F.col("company_code") == normalize_code(F.lit(company)))
    if product:
        found = found.filter(F.col("product_code") == normalize_code(F.lit(product)))
    if agent:
        found = found.filter(F.col("agent_id") == agent)
    return found



_SUMMARY_KEYS = ["agent_id", "agent_name", "company_code", "company_name", "product_code", "product_name"]
_MEASURES = ["sales_count", "total_amount_cents"]


def _measured(sales: DataFrame) -> DataFrame:
    """Sales with a count and an amount per row; already summed rows are left as they are."""
    if set(_MEASURES) <= set(sales.columns):
        return sales
    return sales.withColumns({"sales_count": F.lit(1).cast("long"), "total_amount_cents": F.col("amount_cents")})


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in _MEASURES]


def sales_totals(filtered: DataFrame) -> DataFrame:
    """Number, amount, rounded average ticket and number of agents, in one row."""
    agg = _measured(filtered).agg(*_sums(), F.countDistinct("agent_id").alias("active_agents"))
    # Exact rounded quotient of two longs, halves up; amounts are never negative.
    count, amount = F.col("sales_count"), F.col("total_amount_cents")
    average = F.when(count > 0, F.call_function("div", amount * 2 + count, count * 2)).otherwise(F.lit(0))
    return agg.select(*_MEASURES, average.cast("long").alias("average_ticket_cents"), "active_agents")


def _grouped(filtered: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _measured(filtered).groupBy(*keys).agg(*_sums())


def _ranked(filtered: DataFrame, first: str, second: str, top_n: int | None) -> DataFrame:
    ranked = _grouped(filtered, ["agent_id", "agent_name"]).orderBy(
        F.desc(first), F.desc(second), "agent_id", "agent_name"
    )
    return ranked.limit(top_n) if top_n else ranked


def sales_rank_closings(filtered: DataFrame, top_n: int | None = None) -> DataFrame:
    return _ranked(filtered, "sales_count", "total_amount_cents", top_n)


def sales_rank_amount(filtered: DataFrame, top_n: int | None = None) -> DataFrame:
    return _ranked(filtered, "total_amount_cents", "sales_count", top_n)


def sales_by_company(filtered: DataFrame) -> DataFrame:
    keys = ["company_code", "company_name"]
    return _grouped(filtered, keys).orderBy(F.desc("total_amount_cents"), *keys)


def sales_by_product(filtered: DataFrame) -> DataFrame:
    keys = ["company_code", "product_code", "product_name"]
    return _grouped(filtered, keys).orderBy(F.desc("total_amount_cents"), *keys)


def sales_summary(
    sales: DataFrame, companies: DataFrame, products: DataFrame, start: Instant, end: Instant, **filters: str
) -> dict[str, DataFrame]:
    """All dashboard tables from one pass over the sales.

    The sales are summed once per agent and product and that summary is written out; the
    tables are aggregates of it, and so agree with each other.
    """
    filtered = sales_filtered(sales_enriched(sales, companies, products), start, end, **filters)
    summed = cut(_grouped(filtered, _SUMMARY_KEYS), "sales-summary")
    return {
        "totals": sales_totals(summed),
        "by_closings": sales_rank_closings(summed),
        "by_amount": sales_rank_amount(summed),
        "by_company": sales_by_company(summed),
        "by_product": sales_by_product(summed),
    }


def sales_page(
    filtered: DataFrame,
    limit: int | str | None = None,
    offset: int = 0,
    after: tuple[Instant, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, total), newest first. `after` = (sold_at, id) of the last row seen
    replaces a deep offset: its cost does not grow with the page number."""
    rows = filtered
    if after is not None:
        at = instant(as_utc(after[0]))
        same = (F.col("sold_at") == at) & (F.col("id") < after[1])
        rows = rows.filter((F.col("sold_at") < at) | same)
    limit = clamp(limit, 1, PAGE_LIMIT, PAGE_DEFAULT)
    shown = page(rows, [F.desc("sold_at"), F.desc("id")], limit, offset)
    return shown, filtered.agg(F.count("*").alias("total"))
