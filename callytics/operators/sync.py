"""Export of clock events to per-agent files, and its bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callytics.functions.text import tab_name
from callytics.functions.time import DEFAULT_ZONE, local_date, local_time

REPORT_ROWS = 20


def clock_export(events: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Rows of the agents' sheets: tab, local date, local time, action."""
    return events.select(
        "id",
        tab_name(F.col("display_name"), F.col("agent_id")).alias("tab_name"),
        local_date(F.col("event_at"), zone).alias("fecha"),
        local_time(F.col("event_at"), zone).alias("hora"),
        F.col("action").alias("accion"),
    )


def write_clock_export(export: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append one folder per tab, with a header line (Fecha, Hora, Acción)."""
    rows = export.select(
        "tab_name",
        F.col("fecha").alias("Fecha"),
        F.col("hora").alias("Hora"),
        F.col("accion").alias("Acción"),
    )
    (
        # Few files per tab; a large tab is split over several tasks.
        rows.hint("rebalance", "tab_name")
        .write.mode("append")
        .option("header", True)
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("tab_name")
        .csv(path)
    )


def apply_sync_results(events: DataFrame, results: DataFrame) -> DataFrame:
    """Mark exported events as synced and keep the error of failed ones.

    `results`: id, ok, error, and `at` where an event can have several. One success marks the event; its error is that of
    the last failure, the greatest text among equal times.
    """
    at = F.col("at") if "at" in results.columns else F.lit(0)
    failure = F.when(~F.col("ok"), F.struct(at.alias("at"), F.col("error")))
    told = results.groupBy("id").agg(F.bool_or("ok").alias("_ok"), F.max(failure).alias("_failure"))
    synced = F.when(F.col("_ok"), F.lit(True)).otherwise(F.col("sheets_synced"))
    error = F.when(F.col("_failure").isNotNull(), F.col("_failure.error")).otherwise(F.col("sheets_error"))
    return (
        events.join(told, "id", "left")
        .withColumns({"sheets_synced": synced, "sheets_error": error})
        .select(*events.columns)
    )


def pending_sync(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("sheets_synced"))


def sync_report(events: DataFrame, n: int = REPORT_ROWS) -> DataFrame:
    """The newest events with their export state."""
    newest = events.orderBy(F.desc("event_at"), F.desc("id")).limit(n)
    return newest.select("id", "agent_id", "action", "sheets_synced", "sheets_error")
