from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from callytics.functions.money import with_cents
from callytics.functions.signature import parse_signature
from callytics.operators import audit, catalog, sales_ingest, sales_maintenance, sales_queries as q

ALL = ("2026-01-01T00:00:00Z", "2027-01-01T00:00:00Z")
NOW = "2026-07-01T00:00:00Z"


@pytest.fixture(scope="module")
def enriched(spark):
    return q.sales_enriched(fx.sales(spark), *fx.catalog(spark))


def _pairs(df, key):
    return [(r[key], r.sales_count, r.total_amount_cents) for r in df.collect()]


def test_totals_and_rankings(enriched):
    found = q.sales_filtered(enriched, *ALL)
    assert tuple(q.sales_totals(found).collect()[0]) == (30, 1_086_000, 36_200, 5)
    assert _pairs(q.sales_rank_closings(found), "agent_id") == [
        ("001", 7, 314_000), ("002", 6, 300_000), ("003", 6, 172_500), ("004", 6, 116_500), ("005", 5, 183_000),
    ]
    assert [r.agent_id for r in q.sales_rank_amount(found).collect()] == ["001", "002", "005", "003", "004"]
    assert _pairs(q.sales_by_company(found), "company_code") == [
        ("AME", 13, 722_500), ("ETHOS", 9, 209_500), ("NLG", 8, 154_000),
    ]
    products = {(r.company_code, r.product_code): (r.sales_count, r.total_amount_cents) for r in q.sales_by_product(found).collect()}
    assert products[("AME", "WL")] == (4, 570_000) and products[("NLG", "WL")] == (2, 25_000)
    assert len(products) == 9


def test_summary_equals_its_parts(spark, enriched):
    found = q.sales_filtered(enriched, *ALL)
    summary = q.sales_summary(fx.sales(spark), *fx.catalog(spark), *ALL)
    assert summary["totals"].collect() == q.sales_totals(found).collect()
    assert summary["by_closings"].collect() == q.sales_rank_closings(found).collect()
    assert summary["by_product"].collect() == q.sales_by_product(found).collect()


def test_filters(enriched):
    days = q.sales_filtered(enriched, "2026-06-05T00:00:00Z", "2026-06-10T00:00:00Z")
    assert tuple(q.sales_totals(days).collect()[0]) == (10, 305_000, 30_500, 5)
    company = q.sales_filtered(enriched, *ALL, company=" nlg ")
    assert tuple(q.sales_totals(company).collect()[0]) == (8, 154_000, 19_250, 5)
    nothing = q.sales_filtered(enriched, *ALL, agent="none")
    assert tuple(q.sales_totals(nothing).collect()[0]) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        q.sales_filtered(enriched, *reversed(ALL))


def test_pages(enriched):
    found = q.sales_filtered(enriched, *ALL)
    rows, total = q.sales_page(found, 5)
    first = rows.collect()
    assert [r.id for r in first] == [16, 15, 30, 14, 29] and total.collect()[0][0] == 30
    rows, total = q.sales_page(found, 5, offset=99)
    assert rows.collect() == [] and total.collect()[0][0] == 30
    by_offset = [r.id for r in q.sales_page(found, 5, offset=5)[0].collect()]
    last = first[-1]
    after = (last.sold_at, last.id)
    assert [r.id for r in q.sales_page(found, 5, after=after)[0].collect()] == by_offset


def test_signatures(spark):
    inputs = ["imm", " UW ", "2026-06-20", "5/7/2026", "31/02/2026", "2026-02-31", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "n int, t string")
    parsed = parse_signature(df, "t").orderBy("n")
    got = [tuple(r) for r in parsed.select("signature_status", "signature_date", "followup_code").collect()]
    assert got == [
        ("IMM", None, "IMM"), ("UW", None, "UW"), ("DATE", date(2026, 6, 20), None), ("DATE", date(2026, 7, 5), None),
        (None, None, None), (None, None, None), (None, None, None), (None, None, None),
    ]


def test_amounts(spark):
    inputs = ["100", "1.005", "0.125", " 7 ", "1e2", "0", "-1", "abc", "NaN", "Infinity", "12d", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "n int, t string")
    got = [r.cents for r in with_cents(df, "t", "cents").orderBy("n").collect()]
    assert got == [10_000, 100, 13, 700, 10_000] + [None] * 8


RAW = (
    "id bigint, discord_interaction_id string, discord_message_id string, discord_guild_id string, "
    "discord_channel_id string, agent_id string, agent_name string, company_code string, product_code string, "
    "client_name string, amount string, currency string, billing_period string, signature_input string, "
    "raw_text string, sold_at string, notes string"
)
GOOD = dict(
    agent_id="1", agent_name=" Ana ", company_code=" nlg ", product_code="wl", client_name="  Eva ", amount="10",
    signature_input="imm",
)


def _raw(spark, *changes):
    names = [part.strip().split(" ")[0] for part in RAW.split(",")]
    rows = [tuple({**GOOD, "id": i, **c}.get(n) for n in names) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, RAW)


def test_ingestion_defaults_and_rejects(spark):
    accepted, rejected = sales_ingest.sales_ingest(
        _raw(
            spark,
            {},
            {"amount": "0", "signature_input": "x"},
            {"signature_input": "x", "company_code": " "},
            {"company_code": " ", "product_code": " "},
            {"product_code": " ", "client_name": " "},
            {"client_name": " "},
            {"client_name": ""},
            {"billing_period": "week"},
            {"sold_at": "2026-01-01"},
            {"agent_id": None, "amount": "0"},
            {"sold_at": "2026-01-01T00:00:00+02:00", "currency": " mxn ", "billing_period": "once"},
        ),
        NOW,
    )
    assert [r.error for r in rejected.orderBy("id").collect()] == [
        "invalid_amount", "invalid_signature_input", "invalid_company", "invalid_product", "invalid_client_name",
        "invalid_body", "invalid_body", "invalid_body", "invalid_body",
    ]
    first, last = accepted.withColumn("sold_at", F.col("sold_at").cast("timestamp_ntz")).orderBy("id").collect()
    assert (first.agent_name, first.company_code, first.product_code, first.client_name) == ("Ana", "NLG", "WL", "Eva")
    assert (first.currency, first.billing_period, first.sold_at) == ("USD", "month", datetime(2026, 7, 1))
    assert (last.currency, last.billing_period, last.sold_at) == ("MXN", "once", datetime(2025, 12, 31, 22))


def test_recording_extends_the_catalogue(spark):
    companies, products = fx.catalog(spark)
    companies = companies.withColumns({"active": F.col("code") != "NLG", "name": F.lower("code")})
    done = sales_ingest.record_sales(
        _raw(
            spark,
            {"discord_message_id": "m1"},
            {"discord_message_id": "m1"},
            {"company_code": "new", "product_code": "p1"},
            {"company_code": "new", "product_code": "p2"},
            {"company_code": "lost", "client_name": " "},
        ),
        companies, products, NOW,
    )
    assert [r.id for r in done.duplicates.collect()] == [1] and [r.id for r in done.rejected.collect()] == [4]
    names = {r.code: (r.id, r.name, r.active) for r in done.companies.collect()}
    assert names["NLG"] == (2, "NLG", True) and names["AME"] == (1, "ame", True)
    assert names["NEW"][0] > 3 and "LOST" not in names
    sold = {r.id: (r.company_id, r.product_id) for r in done.sales.collect()}
    assert sold[0] == (2, 6) and sold[2][0] == sold[3][0] == names["NEW"][0] and sold[2][1] != sold[3][1]
    ids = [r.id for r in done.products.collect()]
    assert len(ids) == len(set(ids)) == 11 and min(sold[2][1], sold[3][1]) > 9


def test_duplicates_against_stored_sales(spark):
    new = _raw(spark, {"discord_message_id": "m1"}, {}, {}, {"discord_message_id": "m99"}, {"discord_message_id": "m99"})
    kept, duplicates = sales_ingest.sales_dedup(new, fx.sales(spark))
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
    assert sorted(r.id for r in duplicates.collect()) == [0, 4]


def test_catalogue_lists_active_rows_only(spark):
    companies, products = fx.catalog(spark)
    products = products.withColumn("active", (F.col("company_id") != 2) & (F.col("code") != "WL"))
    listed = catalog.sales_catalog(companies.withColumn("active", F.col("id") != 3), products).collect()
    assert [(r.company_code, r.product_code) for r in listed] == [("AME", "EAG"), ("AME", "IUL"), ("NLG", None)]


def test_updates_merge_and_reject(spark):
    sales, (companies, products) = fx.sales(spark), fx.catalog(spark)
    names = (
        "id bigint, patched_at string, company_code string, product_code string, client_name string, amount string, "
        "currency string, billing_period string, signature_input string, sold_at string, notes string, notes_set boolean"
    )
    at = "2026-06-{} 00:00:00"
    patches = spark.createDataFrame(
        [
            (1, at.format(28), None, None, "  Zoe ", "12.5", None, None, None, None, None, None),
            (1, at.format(29), None, "wl", None, None, " eur", None, "1/8/2026", None, None, True),
            (2, at.format(28), None, None, None, "0", None, None, None, None, None, None),
            (2, at.format(29), None, None, None, None, None, "year", None, None, "kept", False),
            (3, at.format(28), None, None, None, None, "", None, None, None, None, None),
            (3, at.format(28), None, None, None, None, " ", None, None, None, None, None),
            (3, at.format(28), None, None, None, None, None, None, "", None, None, None),
            (4, at.format(28), None, None, "Ana", "10", None, None, None, None, "from Ana", True),
            (4, at.format(28), None, None, "Eva", "20", None, None, None, None, "from Eva", True),
            (99, at.format(28), None, None, "X", None, None, None, None, None, None, None),
        ],
        names,
    ).withColumns({"patched_at": F.col("patched_at").cast("timestamp"), "sold_at": F.col("sold_at").cast("timestamp")})
    done = sales_maintenance.sales_update(sales, patches, companies, products, NOW)
    after = {r.id: r for r in done.sales.collect()}
    one = after[1]
    assert (one.client_name, one.amount_cents, one.currency, one.notes) == ("Zoe", 1_250, "EUR", None)
    assert (one.signature_status, one.signature_date, one.followup_code) == ("DATE", date(2026, 8, 1), None)
    assert one.product_id == 3 and one.company_id == 1
    assert (after[2].billing_period, after[2].signature_status, after[2].notes) == ("year", "UW", "mock_dashboard_seed")
    assert after[2].amount_cents == 17_500 and len(after) == 30
    assert after[3] == {r.id: r for r in sales.collect()}[3]
    assert [r.id for r in done.missing.collect()] == [99]
    four = after[4]  # one of two patches at one time, whole
    assert (four.client_name, four.amount_cents, four.notes) in (("Ana", 1_000, "from Ana"), ("Eva", 2_000, "from Eva"))
    rejected = sorted((r.id, r.error) for r in done.rejected.collect())
    assert rejected == [(2, "invalid_amount")] + [(3, "invalid_body")] * 3


def test_delete_and_reload(spark):
    sales = fx.sales(spark)
    left, missing = sales_maintenance.sales_delete(sales, spark.createDataFrame([(1,), (77,)], "id bigint"))
    assert left.count() == 29 and [r.id for r in missing.collect()] == [77]
    mixed = sales.withColumn("notes", F.when(F.col("id") > 20, F.col("notes")).when(F.col("id") > 10, "own"))
    again = sales_maintenance.sales_reload(mixed, sales.filter("id <= 3"))
    assert again.count() == 23


def test_audit_finds_what_is_wrong(spark):
    sales, (companies, products) = fx.sales(spark), fx.catalog(spark)
    codes = spark.createDataFrame([("IMM", "a", True), ("UW", "b", True)], "code string, label string, active boolean")
    tables = {"sales": sales, "companies": companies, "products": products, "followup_codes": codes}
    assert {r.bad_rows for r in audit.constraint_audit(tables).collect()} == {0}
    broken = sales.withColumns(
        {
            "signature_date": F.when(F.col("id") == 1, F.lit("2026-01-01").cast("date")).otherwise(F.col("signature_date")),
            "company_id": F.when(F.col("id") <= 2, 9).otherwise(F.col("company_id")),
            "discord_message_id": F.when(F.col("id") <= 4, "m").otherwise(F.col("discord_message_id")),
        }
    )
    found = {r.rule: r.bad_rows for r in audit.constraint_audit({**tables, "sales": broken}).collect()}
    assert {k: v for k, v in found.items() if v} == {
        "sales.signature_date": 1, "sales.company_id references companies": 2, "sales unique (discord_message_id)": 3,
    }


def _files(path):
    import os

    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_stored_sales_are_rewritten_by_day(spark, tmp_path):
    from callytics.sources.tables import load_periods, write_periods

    path, sales = str(tmp_path / "sales"), fx.sales(spark)
    # Every third sale was seeded; all of 3 June are.
    seeded = (F.col("id") % 3 == 0) | (F.to_date("sold_at") == "2026-06-03")
    mixed = sales.withColumn("notes", F.when(seeded, F.col("notes")))
    write_periods(mixed, path, F.col("sold_at"))
    before = _files(path)
    fresh = sales.filter("id <= 2").withColumn("id", -F.col("id"))
    want = sorted(map(tuple, sales_maintenance.sales_reload(mixed, fresh).select("id", "notes").collect()))
    for _ in range(2):  # done again it gives the same table
        sales_maintenance.reload_stored(path, fresh)
        stored = load_periods(spark, path, "sales")
        assert sorted(map(tuple, stored.select("id", "notes").collect())) == want
        assert stored.filter("period <> to_date(sold_at)").count() == 0
    after = _files(path)
    touched = {r[0].isoformat() for r in mixed.filter("notes is not null").union(fresh.select(*mixed.columns)).select(F.to_date("sold_at")).distinct().collect()}
    kept = {f for f in before if not any(f"period={day}" in f for day in touched)}
    assert kept and all(after.get(f) == before[f] for f in kept) and not any(f in after for f in set(before) - kept)
    assert not any("period=2026-06-03" in f for f in after)

    sales_maintenance.delete_stored(path, spark.createDataFrame([(4,), (999,)], "id bigint"))
    assert sorted(r.id for r in load_periods(spark, path, "sales").select("id").collect()) == [i for i, _ in want if i != 4]
