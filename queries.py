"""Every operator as a query over the given tables: name -> callable(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, TimestampType

from callytics.operators import (
    attendance,
    audit,
    catalog,
    prompts,
    sales_ingest,
    sales_maintenance,
    sales_queries,
    stages,
    suggestions,
    sync,
    transcripts,
)
from callytics.plans.keyed import upsert
from callytics.plans.lineage import cut
from callytics.plans.slices import Spread
from callytics.session import checkpoint_root, prepare
from callytics.sources import bindings as b
from callytics.sources.raw import stream_raw
from callytics.sources.tables import append, load, load_periods, write_periods
from callytics.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

FROM, TO, NOW = "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z", "2024-02-01T00:00:00Z"
SOLD_FROM, SOLD_TO = "1996-01-01T00:00:00Z", "1999-01-01T00:00:00Z"
TTL_SECONDS = 90
SYSTEM_PROMPT = "Sugiere una sola frase."

QUERIES: dict[str, Query] = {}


def flat(df: DataFrame) -> DataFrame:
    """Plain columns for comparing: zone-free timestamps, long numbers, dates and arrays as text."""
    out = []
    for field in df.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, TimestampType):
            value = value.cast("timestamp_ntz")
        elif isinstance(field.dataType, DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, IntegerType):
            value = value.cast("long")
        elif isinstance(field.dataType, ArrayType):
            value = F.array_join(value, "|")
        out.append(value.alias(field.name))
    return df.select(*out)


def as_text(df: DataFrame, column: str) -> DataFrame:
    """A number that may be null as text, which tools read alike."""
    return df.withColumn(column, F.col(column).cast("string"))


def query(function: Query, name: str | None = None) -> Query:
    """Register under the function's name, with the session settings applied."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return flat(function(prepare(spark), folder))

    QUERIES[name or function.__name__] = run
    return run


def query_as(name: str) -> Callable[[Query], Query]:
    """Register under a name that a module already has here."""
    return lambda function: query(function, name)


# Attendance


@query
def clock_validate(spark, folder):
    judged = attendance.clock_validate(
        b.clock_attempts(spark, folder), spread=b.event_spread(spark, folder)
    )
    return judged.select("id", "agent_id", "action", "event_at", "accepted", "error", "last_action", "last_at")


@query
def clock_status(spark, folder):
    return attendance.clock_status(b.clock_events(spark, folder), b.agents(spark, folder))


@query
def clock_history(spark, folder):
    return attendance.clock_history(b.clock_events(spark, folder), "7", 50)


@query
def clock_history_all(spark, folder):
    return attendance.clock_history_all(b.clock_events(spark, folder), 5)


@query
def latest_per_agent(spark, folder):
    return attendance.latest_per_agent(b.clock_events(spark, folder))


@query
def bulk_clock_out(spark, folder):
    return attendance.bulk_clock_out(b.clock_events(spark, folder), NOW)


@query
def clock_shifts(spark, folder):
    return attendance.clock_shifts(b.clock_events(spark, folder), FROM, TO, b.event_spread(spark, folder))


@query
def clock_shifts_clipped(spark, folder):
    shifts = attendance.clock_shifts(
        b.clock_events(spark, folder), FROM, TO, b.event_spread(spark, folder)
    )
    return attendance.clip_shifts(shifts, FROM, TO, NOW)


@query
def clock_summary(spark, folder):
    return attendance.clock_summary(
        b.clock_events(spark, folder), FROM, TO, NOW, spread=b.event_spread(spark, folder)
    )


@query
def clock_shift_list(spark, folder):
    listed = attendance.clock_shift_list(
        b.clock_events(spark, folder), FROM, TO, spread=b.event_spread(spark, folder)
    )
    return as_text(listed, "duration_minutes")


@query
def clock_events_page(spark, folder):
    return attendance.clock_events_page(b.clock_events(spark, folder), FROM, TO, limit=40, offset=25)


@query
def clock_events_count(spark, folder):
    return attendance.clock_events_count(b.clock_events(spark, folder), FROM, TO)


@query
def clock_export(spark, folder):
    return sync.clock_export(b.clock_events(spark, folder))


@query
def clock_sync_apply(spark, folder):
    applied = sync.apply_sync_results(b.clock_events(spark, folder), b.sync_results(spark, folder))
    return applied.select("id", "agent_id", "sheets_synced", "sheets_error")


@query
def clock_sync_pending(spark, folder):
    return sync.pending_sync(b.clock_events(spark, folder))


@query
def clock_sync_report(spark, folder):
    return sync.sync_report(b.clock_events(spark, folder))


@query
def users_upsert(spark, folder):
    changes = b.user_changes(spark, folder)
    return upsert(
        b.users(spark, folder), changes, ["agent_id"], ["username", "avatar", "updated_at"], "updated_at"
    )


# Sales: ingestion and catalogue


@query_as("sales_ingest")
def sales_ingested(spark, folder):
    return sales_ingest.sales_ingest(b.raw_sales(spark, folder), NOW)[0]


@query
def sales_rejects(spark, folder):
    rejected = sales_ingest.sales_ingest(b.raw_sales(spark, folder), NOW)[1]
    return rejected.select("id", "agent_id", "amount", "signature_input", "error")


@query
def sales_signature(spark, folder):
    return sales_ingest.sales_signature(b.raw_sales(spark, folder))


def _batches(spark, folder):
    """Sale requests with repeated message ids, before and after the start of 1996."""
    raw = b.raw_sales(spark, folder).withColumn("_year", F.element_at(F.split("discord_message_id", "-"), -1))
    return raw.filter("coalesce(_year, '1996') >= '1996'"), raw.filter("_year < '1996'")


@query
def sales_dedup(spark, folder):
    new, stored = _batches(spark, folder)
    kept, _ = sales_ingest.sales_dedup(new, stored)
    return kept.select("id", "discord_message_id", "agent_id")


@query
def sales_duplicates(spark, folder):
    raw = b.raw_sales(spark, folder)
    _, duplicates = sales_ingest.sales_dedup(raw, raw.filter(F.col("amount") == "n/a"))
    return duplicates.select("id", "discord_message_id", "agent_id")


@query
def sales_recorded(spark, folder):
    """The whole ingestion; ids of new catalogue rows are left out, as their order is free."""
    companies, products = b.companies(spark, folder), b.products(spark, folder)
    raw = b.raw_sales(spark, folder)
    raw = raw.withColumn("company_code", F.when(F.col("id") % 4 == 0, F.concat(F.lit("new_"), F.trim("company_code"))).otherwise(F.col("company_code")))
    done = sales_ingest.record_sales(raw, companies, products, NOW)
    named = sales_queries.sales_enriched(done.sales, done.companies, done.products)
    return named.select(
        "id", "agent_id", "company_code", "company_name", "product_code", "product_name", "amount_cents"
    )


def _wanted(spark, folder):
    """Upper-cased codes of accepted requests, as a batch of catalogue codes."""
    accepted, _ = sales_ingest.sales_ingest(b.raw_sales(spark, folder), NOW)
    return accepted.select(
        _renamed("company_code", F.col("billing_period") == "year"), _renamed("product_code", F.col("currency") == "MXN")
    )


def _renamed(code, when):
    """A code, or where the condition holds one that the catalogue doesn't have."""
    return F.when(when, F.concat(F.lit("NEW_"), code)).otherwise(F.col(code)).alias(code)


def _catalog_rows(companies, products, known):
    """Companies and products side by side; an id stays only where it was known before."""
    company = companies.select(
        F.lit("company").alias("kind"), F.lit("").alias("company"), "code", "name", "active",
        F.when(F.col("id") <= known, F.col("id")).alias("known_id"),
    )
    owner = companies.select(F.col("id").alias("company_id"), F.col("code").alias("company"))
    product = products.join(owner, "company_id").select(
        F.lit("product").alias("kind"), "company", "code", "name", "active",
        F.lit(None).cast("long").alias("known_id"),
    )
    return as_text(company.unionByName(product), "known_id")


@query
def catalog_upsert(spark, folder):
    companies, products = b.companies(spark, folder), b.products(spark, folder)
    return _catalog_rows(*catalog.catalog_upsert(companies, products, _wanted(spark, folder)), known=24)


@query
def catalog_reconcile(spark, folder):
    companies, products = b.companies(spark, folder), b.products(spark, folder)
    wanted = _wanted(spark, folder)
    wanted = wanted.select(
        _renamed("company_code", F.col("company_code") <= "NATION_15"), _renamed("product_code", F.col("product_code") == "FURNITURE")
    )
    return _catalog_rows(*catalog.catalog_reconcile(companies, products, wanted), known=24)


@query
def sales_catalog(spark, folder):
    return catalog.sales_catalog(b.companies(spark, folder), b.products(spark, folder))


@query
def followup_codes(spark, folder):
    """The codes in use by sales, with their labels."""
    used = b.sales(spark, folder).select(F.col("followup_code").alias("code")).distinct()
    return catalog.followup_codes(b.followup_codes(spark).join(used, "code", "left_semi"))


@query
def catalog_matrix(spark, folder):
    return catalog.catalog_matrix(b.companies(spark, folder), [(s, s.title()) for s in b.SEGMENTS])


@query
def constraint_audit(spark, folder):
    """Clean and unclean tables: weekly periods, dated signatures without date, lost companies."""
    sales = b.sales(spark, folder).withColumns(
        {
            "discord_message_id": F.concat_ws("-", "agent_id", F.year("sold_at")),
            "billing_period": F.when(F.col("notes") == "5-LOW", "week").otherwise(F.col("billing_period")),
            "signature_date": F.when(F.col("amount_cents") > 10_000_000, F.col("signature_date")),
            "followup_code": F.when(F.col("notes") == "2-HIGH", "??").otherwise(F.col("followup_code")),
            "company_id": F.col("company_id") + F.when(F.col("notes") == "4-NOT SPECIFIED", 100).otherwise(0),
        }
    )
    return audit.constraint_audit(
        {
            "sales": sales,
            "companies": b.companies(spark, folder),
            "products": b.products(spark, folder).withColumn(
                "company_id", F.col("company_id") + F.when(F.col("active"), 0).otherwise(100)
            ),
            "followup_codes": b.followup_codes(spark),
            "clock_events": b.clock_events(spark, folder),
            "transcript_turns": b.turns(spark, folder),
        }
    )


# Sales: queries and maintenance


def _enriched(spark, folder):
    return sales_queries.sales_enriched(
        b.sales(spark, folder), b.companies(spark, folder), b.products(spark, folder)
    )


def _filtered(spark, folder):
    return sales_queries.sales_filtered(_enriched(spark, folder), SOLD_FROM, SOLD_TO)


def _lines(spark, folder):
    return sales_queries.sales_filtered(b.sales_lines(spark, folder), SOLD_FROM, SOLD_TO)


@query
def sales_enriched(spark, folder):
    return _enriched(spark, folder)


@query
def sale_by_id(spark, folder):
    return sales_queries.sale_by_id(_enriched(spark, folder), 42)


@query
def sales_filtered(spark, folder):
    return sales_queries.sales_filtered(
        _enriched(spark, folder), SOLD_FROM, SOLD_TO, company=" nation_3 ", product="building"
    )


@query
def sales_filtered_agent(spark, folder):
    return sales_queries.sales_filtered(_enriched(spark, folder), SOLD_FROM, SOLD_TO, agent="12")


@query
def sales_totals(spark, folder):
    return sales_queries.sales_totals(_filtered(spark, folder))


@query
def sales_rank_closings(spark, folder):
    return sales_queries.sales_rank_closings(_filtered(spark, folder))


@query
def sales_rank_amount(spark, folder):
    return sales_queries.sales_rank_amount(_filtered(spark, folder), top_n=25)


@query
def sales_by_company(spark, folder):
    return sales_queries.sales_by_company(_filtered(spark, folder))


@query
def sales_by_product(spark, folder):
    return sales_queries.sales_by_product(_filtered(spark, folder))


@query
def sales_lines_totals(spark, folder):
    return sales_queries.sales_totals(_lines(spark, folder))


@query
def sales_lines_rank_amount(spark, folder):
    return sales_queries.sales_rank_amount(_lines(spark, folder))


@query
def sales_lines_by_company(spark, folder):
    return sales_queries.sales_by_company(_lines(spark, folder))


@query
def sales_lines_by_product(spark, folder):
    return sales_queries.sales_by_product(_lines(spark, folder))


@query
def sales_summary(spark, folder):
    """All five tables of the dashboard, as one long table."""
    found = sales_queries.sales_summary(
        b.sales(spark, folder), b.companies(spark, folder), b.products(spark, folder), SOLD_FROM, SOLD_TO
    )
    keys = {
        "totals": F.lit("all"),
        "by_closings": F.col("agent_id"),
        "by_amount": F.col("agent_id"),
        "by_company": F.col("company_code"),
        "by_product": F.concat_ws("/", "company_code", "product_code"),
    }
    parts = [
        found[name].select(
            F.lit(name).alias("part"), key.alias("key"), "sales_count", "total_amount_cents"
        )
        for name, key in keys.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def sales_page(spark, folder):
    rows, total = sales_queries.sales_page(_filtered(spark, folder), limit=30, offset=60)
    return rows.select("id", "agent_id", "company_code", "amount_cents", "sold_at").withColumn(
        "total", total.scalar()
    )


@query
def sales_page_after(spark, folder):
    after = ("1998-06-01T00:00:00Z", 1000)
    rows, _ = sales_queries.sales_page(_filtered(spark, folder), limit=30, after=after)
    return rows.select("id", "agent_id", "company_code", "amount_cents", "sold_at")


def _update(spark, folder):
    return sales_maintenance.sales_update(
        b.sales(spark, folder),
        b.sale_patches(spark, folder),
        b.companies(spark, folder),
        b.products(spark, folder),
        NOW,
    )


@query
def sales_update(spark, folder):
    done = _update(spark, folder)
    return sales_queries.sales_enriched(done.sales, done.companies, done.products)


@query
def sales_update_missing(spark, folder):
    return sales_maintenance.missing_patches(b.sales(spark, folder), b.sale_patches(spark, folder))


@query
def sales_update_rejected(spark, folder):
    return sales_maintenance.rejected_patches(b.sale_patches(spark, folder))


def _delete(spark, folder):
    sales = b.sales(spark, folder)
    gone = sales.filter("signature_status = 'UW'").select("id")
    return sales_maintenance.sales_delete(sales, gone.union(sales.agg(F.max("id") + 5)))


@query
def sales_delete(spark, folder):
    return _delete(spark, folder)[0].select("id", "agent_id", "amount_cents", "signature_status")


@query
def sales_delete_missing(spark, folder):
    return _delete(spark, folder)[1]


@query
def sales_reload(spark, folder):
    sales = b.sales(spark, folder)
    fresh = sales.filter("signature_status = 'IMM' and billing_period = 'year'").withColumn(
        "id", -F.col("id") - 1
    )
    path = f"{checkpoint_root(spark)}/sales-{uuid4().hex}"
    write_periods(sales, path, F.col("sold_at"), "quarter")
    sales_maintenance.reload_stored(path, fresh, every="quarter")
    return load_periods(spark, path, "sales").select("id", "agent_id", "amount_cents", "notes")


# Transcripts and sessions


@query
def turns_build(spark, folder):
    return transcripts.turns_build(b.stt_results(spark, folder))


@query
def sessions_silence(spark, folder):
    return transcripts.sessions_silence(
        b.event_starts(spark, folder), b.event_heartbeats(spark, folder), gap_seconds=7_200
    )


@query
def sessions_close(spark, folder):
    return b.sessions(spark, folder)


@query
def transcript_flush(spark, folder):
    return transcripts.transcript_flush(b.turns(spark, folder), b.sessions(spark, folder))


def _recent(spark, folder):
    """The last three minutes of every session."""
    ends = b.turn_heartbeats(spark, folder).groupBy("session_id").agg(F.max("ts").alias("as_of"))
    return transcripts.recent_turns(b.turns(spark, folder), ends, transcripts.COPILOT_WINDOW_MS)


@query
def recent_turns(spark, folder):
    return _recent(spark, folder)


@query
def transcript_excerpt(spark, folder):
    starts = b.session_starts(spark, folder)
    return transcripts.transcript_excerpt(b.turns(spark, folder), starts, max_turns=4)


def _requests(spark, folder):
    """One request a second after every turn."""
    return b.turns(spark, folder).select(
        b.request_id().alias("request_id"), "session_id", (F.col("ts") + 1_000).alias("at")
    )


@query
def transcript_excerpts_at(spark, folder):
    return transcripts.excerpts_at(_requests(spark, folder), b.turns(spark, folder), 100_000, 2)


@query
def session_status(spark, folder):
    return transcripts.session_status(b.sessions(spark, folder), b.agents(spark, folder))


# Stages, signals and suggestions


def _progress(spark, folder):
    return stages.stage_progression(
        b.turns(spark, folder), b.GROUPS, spread=b.turn_spread(spark, folder)
    )


@query
def keyword_matches(spark, folder):
    return stages.keyword_matches(b.turns(spark, folder), b.GROUPS).drop("text")


@query
def turn_stage_detect(spark, folder):
    return stages.turn_stage_detect(b.turns(spark, folder), b.GROUPS).drop("text")


@query
def stage_progression(spark, folder):
    return _progress(spark, folder).select("session_id", "seq", "previous_stage", "stage", "changed")


@query
def stage_changes(spark, folder):
    return stages.stage_changes(_progress(spark, folder))


def _current(spark, folder):
    """Current stages; sessions are all conversations, also those without a turn."""
    everyone = b.load_raw(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("id")
    ).union(b.agents(spark, folder)).distinct()
    return stages.current_stage(_progress(spark, folder), everyone)


@query
def current_stage(spark, folder):
    return _current(spark, folder)


@query
def stage_progression_ttl(spark, folder):
    return stages.stage_progression_ttl(
        b.turns(spark, folder),
        b.session_starts(spark, folder),
        b.GROUPS,
        TTL_SECONDS,
        b.turn_spread(spark, folder),
    )


def _signals(spark, folder):
    return stages.signals(_progress(spark, folder), b.GROUPS)


@query
def signals(spark, folder):
    return _signals(spark, folder)


def _expiring(spark, folder, spread, with_starts=False):
    return stages.stage_progression_ttl(
        b.turns(spark, folder), b.session_starts(spark, folder), b.GROUPS, TTL_SECONDS, spread, with_starts
    )


def _requested(spark, folder):
    """Requests for suggestions, judged."""
    asked = b.manual_requests(spark, folder)
    return stages.judged_requests(asked, b.sessions(spark, folder), b.ms_to_timestamp(F.col("at")))


def _manual(spark, folder, spread=None):
    """Signals of the requests that count, each at the stage the call is in just then."""
    spread = spread or b.turn_spread(spark, folder)
    changes = cut(_expiring(spark, folder, spread, with_starts=True).filter("changed"), "changes")
    intervals = stages.stage_intervals(changes, TTL_SECONDS, spread)
    return stages.manual_signals(_requested(spark, folder).filter("reason is null"), intervals, TTL_SECONDS, spread)


@query
def manual_signals(spark, folder):
    return _manual(spark, folder).drop("seq")


@query
def manual_rejected(spark, folder):
    return _requested(spark, folder).filter("reason is not null")


@query
def playbook_sections(spark, folder):
    found = prompts.playbook_sections(b.playbook_docs(spark, folder))
    return found.select(
        "doc", "level", "heading", F.length("body").alias("chars"), F.md5("body").alias("body_md5")
    )


GUIDE = prompts.section_map({"opening": ("ment",), "closing": ("zz9", "Le ")}, ("tion", "La "), ("que",))


@query
def stage_guidance(spark, folder):
    sections = prompts.playbook_sections(b.playbook_docs(spark, folder))
    found = prompts.stage_guidance(sections, GUIDE)
    return found.select("doc", "stage", F.length("guidance").alias("chars"), F.md5("guidance").alias("text_md5"))


def _prompts_for(spark, folder, raised):
    requests = raised.select("request_id", "session_id", F.col("ts").alias("at"))
    excerpts = prompts.copilot_excerpts(requests, b.turns(spark, folder))
    # The first document with sections for a stage serves as its playbook.
    sections = prompts.playbook_sections(b.playbook_docs(spark, folder))
    guidance = prompts.stage_guidance(sections, GUIDE)
    playbook = guidance.groupBy("stage").agg(F.min(F.struct("doc", "guidance"))["guidance"].alias("guidance"))
    return prompts.copilot_prompts(raised, excerpts, playbook, SYSTEM_PROMPT)


def _prompts(spark, folder):
    """Prompts of the signals; the stage of each is the one that may lapse."""
    stage = _expiring(spark, folder, b.turn_spread(spark, folder)).select("session_id", "ts", "seq", "stage")
    raised = _signals(spark, folder).drop("stage").join(stage, ["session_id", "ts", "seq"])
    return _prompts_for(spark, folder, raised.withColumn("request_id", b.request_id()))


@query
def copilot_prompts(spark, folder):
    return _prompts(spark, folder)


@query
def manual_prompts(spark, folder):
    return _prompts_for(spark, folder, _manual(spark, folder))


@query
def manual_suggestions(spark, folder):
    """What the agents who asked are shown."""
    prompted = _prompts_for(spark, folder, _manual(spark, folder))
    return suggestions.suggestion_log(prompted, _responses(spark, folder), NOW)[0].drop("accepted")


@query
def ask_prompts(spark, folder):
    return prompts.ask_prompts(
        b.agent_questions(spark, folder), b.turns(spark, folder), b.overlapping_sessions(spark, folder), SYSTEM_PROMPT
    )


def _responses(spark, folder):
    """An answer per turn, quoted in several ways; every ninth session fails."""
    failed = F.col("session_id").cast("long") % 9 == 0
    quoted = (
        F.when(F.col("speaker") == "agente", F.concat(F.lit("'\" "), "text", F.lit(" \"'")))
        .otherwise(F.concat(F.lit("\"'"), "text", F.lit("'\"")))
    )
    return b.turns(spark, folder).select(
        b.request_id().alias("request_id"),
        F.when(~failed, quoted).alias("response_text"),
        F.when(failed, "timeout").alias("error"),
        F.length("text").alias("latency_ms"),
        F.lit("m1").alias("model"),
        F.lit("gpt_api").alias("provider"),
    )


@query
def response_clean(spark, folder):
    return suggestions.response_clean(_responses(spark, folder)).select("request_id", "response_text", "error")


@query
def playbook_suggestions(spark, folder):
    return suggestions.playbook_suggestions(_signals(spark, folder))


def _log(spark, folder):
    return suggestions.suggestion_log(_prompts(spark, folder), _responses(spark, folder), NOW)


@query
def suggestion_log_suggestions(spark, folder):
    return _log(spark, folder)[0].drop("accepted")


@query
def suggestion_log_requests(spark, folder):
    return as_text(_log(spark, folder)[1], "suggestion_id")


def _feedback(spark, folder):
    """Half a minute after each signal, from the owner or (every fifth session) someone else."""
    raised = _signals(spark, folder)
    shown = raised.select(
        b.request_id().alias("id"), "session_id", "stage", F.lit(None).cast("boolean").alias("accepted")
    )
    session = F.col("session_id").cast("long")
    given = raised.select(
        b.request_id().alias("suggestion_id"),
        F.when(session % 5 == 0, "nobody").otherwise((session % 10).cast("string")).alias("agent_id"),
        (session % 2 == 0).alias("accepted"),
        b.ms_to_timestamp(F.col("ts") + 30_000).alias("at"),
    )
    unknown = given.withColumn("suggestion_id", -F.col("suggestion_id") - 1)
    return suggestions.suggestion_feedback(shown, b.sessions(spark, folder), given.union(unknown))


@query
def suggestion_feedback(spark, folder):
    return as_text(_feedback(spark, folder)[0], "accepted")


@query
def suggestion_feedback_rejected(spark, folder):
    return _feedback(spark, folder)[1]


# Streams, run over the files once


def _replayed(spark, stream):
    """Run a stream over all its files and read what it wrote."""
    folder = f"{checkpoint_root(spark)}/stream-{uuid4().hex}"
    streams.write_stream(stream, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def stream_clock(spark, folder):
    streams.prepare_streaming(spark)
    return _replayed(spark, streams.stream_clock(b.clock_attempts(spark, folder, stream_raw)))


@query
def stream_status(spark, folder):
    """Who is clocked in, read from the state of the stream."""
    streams.prepare_streaming(spark)
    path = f"{checkpoint_root(spark)}/stream-{uuid4().hex}"
    judged = streams.stream_clock(b.clock_attempts(spark, folder, stream_raw))
    streams.write_stream(judged, f"{path}/out", f"{path}/state", available_now=True).awaitTermination()
    return streams.live_status(spark, f"{path}/state")


@query
def stream_stages(spark, folder):
    streams.prepare_streaming(spark)
    staged = streams.stream_stages(
        b.turns(spark, folder, stream_raw), b.streamed_starts(spark, folder), b.GROUPS, TTL_SECONDS
    )
    return _replayed(spark, staged.drop("text"))


@query
def stream_silence(spark, folder):
    streams.prepare_streaming(spark)
    heartbeats = b.event_heartbeats(spark, folder, stream_raw)
    return _replayed(spark, streams.stream_silence(heartbeats, 7_200))


@query
def stream_recent(spark, folder):
    streams.prepare_streaming(spark)
    return _replayed(spark, streams.stream_recent(b.turns(spark, folder, stream_raw), 100_000, 2))


@query
def stream_transcripts(spark, folder):
    streams.prepare_streaming(spark)
    said = b.turns(spark, folder, stream_raw)
    return _replayed(spark, streams.stream_transcripts(said, b.streamed_ends(spark, folder)))


@query
def append_defaults(spark, folder):
    """Questions of the clients stored with their defaults, and read back."""
    asked = b.turns(spark, folder).filter("speaker = 'cliente'").select(
        b.request_id().alias("id"), "session_id", F.col("text").alias("question")
    )
    path = f"{checkpoint_root(spark)}/append-{uuid4().hex}"
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    append(asked, path, "questions", {"answer": "", "asked_at": now})
    return load(spark, path, "questions")


# The plan for hot keys, with so low a bound that many keys of the given tables count as hot

HOT_EVENTS, HOT_TURNS = Spread(hot_rows=50, slice_rows=40), Spread(hot_rows=3, slice_rows=10)


@query
def clock_validate_hot(spark, folder):
    judged = attendance.clock_validate(b.clock_attempts(spark, folder), spread=HOT_EVENTS)
    return judged.select("id", "agent_id", "action", "event_at", "accepted", "error", "last_action", "last_at")


@query
def clock_shifts_hot(spark, folder):
    return attendance.clock_shifts(b.clock_events(spark, folder), FROM, TO, HOT_EVENTS)


@query
def stage_progression_hot(spark, folder):
    progress = stages.stage_progression(b.turns(spark, folder), b.GROUPS, spread=HOT_TURNS)
    return progress.select("session_id", "seq", "previous_stage", "stage", "changed")


@query
def stage_progression_ttl_hot(spark, folder):
    starts = b.session_starts(spark, folder)
    return stages.stage_progression_ttl(b.turns(spark, folder), starts, b.GROUPS, TTL_SECONDS, HOT_TURNS)


@query
def manual_signals_hot(spark, folder):
    return _manual(spark, folder, HOT_TURNS).drop("seq")
