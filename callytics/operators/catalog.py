"""Companies, products and follow-up codes of the sales catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from callytics.plans.keyed import with_new_ids
from callytics.plans.lineage import cut


def _max_id(table: DataFrame):
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()


def _upsert_codes(table: DataFrame, wanted: DataFrame, keys: Sequence[str], deactivate: bool) -> DataFrame:
    """Wanted codes become active and are named after their code; unknown ones get new ids."""
    marked = wanted.select(*keys).distinct().withColumn("_wanted", F.lit(True))
    others = F.lit(False) if deactivate else F.col("active")
    merged = table.join(marked, list(keys), "full_outer").withColumns(
        {
            "name": F.when(F.col("_wanted"), F.col("code")).otherwise(F.col("name")),
            "active": F.when(F.col("_wanted"), F.lit(True)).otherwise(others),
        }
    )
    return with_new_ids(merged, keys, _max_id(table)).select(*table.columns)


def catalog_upsert(
    companies: DataFrame, products: DataFrame, codes: DataFrame, deactivate: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Add or reactivate the (company_code, product_code) pairs of `codes`.

    With `deactivate`, every company and product that is not wanted is switched off. The
    distinct codes and the new catalogue are written out, so a batch is read once for them.
    """
    wanted = cut(codes.select("company_code", "product_code").distinct(), "codes")
    company_codes = wanted.select(F.col("company_code").alias("code"))
    companies_now = cut(_upsert_codes(companies, company_codes, ["code"], deactivate), "companies")
    ids = companies_now.select(F.col("id").alias("company_id"), F.col("code").alias("company_code"))
    pairs = wanted.join(ids, "company_code").select("company_id", F.col("product_code").alias("code"))
    return companies_now, cut(_upsert_codes(products, pairs, ["company_id", "code"], deactivate), "products")


def catalog_reconcile(
    companies: DataFrame, products: DataFrame, wanted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Make the catalogue hold exactly the wanted pairs as active ones."""
    return catalog_upsert(companies, products, wanted, deactivate=True)


def catalog_matrix(
    companies: DataFrame, codes: Sequence[tuple[str, str]], company_codes: Sequence[str] | None = None
) -> DataFrame:
    """Every chosen company with every (code, name) of a literal product list."""
    if company_codes is not None:
        companies = companies.filter(F.col("code").isin(list(company_codes)))
    listed = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("name")) for c, n in codes])
    return companies.select(
        F.col("id").alias("company_id"), F.col("code").alias("company_code"), F.explode(listed).alias("_p")
    ).select("company_id", "company_code", F.col("_p.code").alias("code"), F.col("_p.name").alias("name"))


def sales_catalog(companies: DataFrame, products: DataFrame) -> DataFrame:
    """Active companies with their active products; one row with nulls when there is none."""
    offered = products.filter("active").select(
        F.col("company_id").alias("id"),
        F.col("id").alias("product_id"),
        F.col("code").alias("product_code"),
        F.col("name").alias("product_name"),
    )
    return (
        companies.filter("active")
        .select("id", F.col("code").alias("company_code"), F.col("name").alias("company_name"))
        .join(offered, "id", "left")
        .withColumnRenamed("id", "company_id")
        .orderBy("company_code", "product_code")
    )


def followup_codes(codes: DataFrame) -> DataFrame:
    return codes.filter("active").select("code", "label").orderBy("code")
