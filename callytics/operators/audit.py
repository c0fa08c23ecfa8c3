"""Checks of the constraints a relational store would enforce."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from callytics.sources.schemas import (
    ACTIVE,
    AGENT,
    BILLING_PERIODS,
    CLIENT,
    CLOCK_IN,
    CLOCK_OUT,
    ENDED,
    SIGNATURE_STATUSES,
    SUGGESTION_SOURCES,
)


def _one_of(name: str, values: Sequence) -> Column:
    return F.coalesce(~F.col(name).isin(*values), F.lit(True))


def _row_rules() -> dict[str, dict[str, Column]]:
    dated, date = F.col("signature_status") == "DATE", F.col("signature_date")
    return {
        "sessions": {"status": _one_of("status", (ACTIVE, ENDED))},
        "transcript_turns": {
            "speaker": _one_of("speaker", (AGENT, CLIENT)),
            "channel": _one_of("channel", (0, 1)),
        },
        "clock_events": {"action": _one_of("action", (CLOCK_IN, CLOCK_OUT))},
        "copilot_suggestions": {"source": _one_of("source", SUGGESTION_SOURCES)},
        "copilot_request_logs": {"provider": _one_of("provider", SUGGESTION_SOURCES)},
        "sales": {
            "amount_cents": F.coalesce(F.col("amount_cents") < 0, F.lit(True)),
            "billing_period": _one_of("billing_period", BILLING_PERIODS),
            "signature_status": _one_of("signature_status", SIGNATURE_STATUSES),
            "signature_date": F.coalesce(dated, F.lit(False)) != date.isNotNull(),
        },
    }


# Unique keys and references of the stored tables.
UNIQUE = {
    "users": ["agent_id"],
    "sessions": ["id"],
    "clock_events": ["id"],
    "companies": ["code"],
    "products": ["company_id", "code"],
    "followup_codes": ["code"],
    "sales": ["discord_message_id"],
}
REFERENCES = [
    ("sales", "company_id", "companies", "id"),
    ("sales", "product_id", "products", "id"),
    ("sales", "followup_code", "followup_codes", "code"),
    ("products", "company_id", "companies", "id"),
    ("sessions", "agent_id", "users", "agent_id"),
    ("transcript_turns", "session_id", "sessions", "id"),
    ("questions", "session_id", "sessions", "id"),
    ("copilot_suggestions", "session_id", "sessions", "id"),
    ("copilot_request_logs", "session_id", "sessions", "id"),
    ("copilot_request_logs", "suggestion_id", "copilot_suggestions", "id"),
]


def _audited(name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, bad_rows) of one table, which is scanned once.

    Rows are grouped by each of its key columns at once (grouping sets) and counted, with the row rules in the set of
    all rows. So a hot value crosses the shuffle as one row per task. The values of referenced keys are then joined with
    all counts at once.
    """
    table, rules = tables[name], _row_rules().get(name, {})
    unique = UNIQUE.get(name)
    references = [(column, other, key) for t, column, other, key in REFERENCES if t == name and other in tables]
    sets = [list(unique)] if unique else []
    sets += [[column] for column, _, _ in references]
    sets = list(map(list, dict.fromkeys(map(tuple, sets))))
    columns = list(dict.fromkeys(c for s in sets for c in s))
    bad = [F.count_if(rule).alias(f"_bad_{n}") for n, rule in rules.items()]
    if not sets:
        counted = table.agg(*bad).withColumns({"_set": F.lit(-1), "_n": F.lit(0).cast("long"), "_key": F.lit(None).cast("string")})
    else:
        marks = {f"_key_{c}": F.col(c) for c in columns}
        keyed = [[F.col(f"_key_{c}") for c in s] for s in [[], *sets]]
        grouped = table.withColumns(marks).groupingSets(keyed, *marks)
        counted = grouped.agg(F.count("*").alias("_n"), F.grouping_id().alias("_id"), *bad)
        # In a grouping id the bit of a column is set where the column is not grouped by.
        ids = [sum(1 << (len(columns) - 1 - columns.index(c)) for c in columns if c not in s) for s in sets]
        number = F.coalesce(*[F.when(F.col("_id") == i, F.lit(n)) for n, i in enumerate(ids)], F.lit(-1))
        texts = [F.col(f"_key_{c}").cast("string") for c in columns]
        counted = counted.withColumns({"_set": number, "_key": F.concat_ws("\x1f", *texts)})
        # A key with a null in it is neither repeated nor lost.
        present = F.coalesce(
            *[F.when(F.col("_set") == n, reduce(lambda a, b: a & b, [F.col(f"_key_{c}").isNotNull() for c in s])) for n, s in enumerate(sets)],
            F.lit(True),
        )
        counted = counted.filter(present)
    known = None
    for column, other, key in references:
        values = tables[other].select(F.lit(sets.index([column])).alias("_set"), F.col(key).cast("string").alias("_key"), F.lit(other).alias("_other"))
        known = values.distinct() if known is None else known.unionByName(values.distinct())
    if known is not None:
        met = known.groupBy("_set", "_key").agg(F.collect_set("_other").alias("_met"))  # as many as there are references
        counted = counted.join(met, ["_set", "_key"], "left")
    told = [(f"{name}.{n}", F.sum(F.when(F.col("_set") == -1, F.col(f"_bad_{n}")))) for n in rules]
    if unique:
        at = sets.index(list(unique))
        told.append((f"{name} unique ({', '.join(unique)})", F.sum(F.when(F.col("_set") == at, F.col("_n") - 1))))
    for column, other, _ in references:
        lost = (F.col("_set") == sets.index([column])) & ~F.coalesce(F.array_contains("_met", other), F.lit(False))
        told.append((f"{name}.{column} references {other}", F.sum(F.when(lost, F.col("_n")))))
    totals = counted.agg(*[F.coalesce(total, F.lit(0)).alias(f"_{i}") for i, (_, total) in enumerate(told)])
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"_{i}").alias("bad_rows")) for i, (rule, _) in enumerate(told)])
    return totals.select(F.inline(rows))


def constraint_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, bad_rows) for every rule whose tables are given; one pass over each table."""
    ruled = [t for t in tables if t in _row_rules() or t in UNIQUE or any(r[0] == t and r[2] in tables for r in REFERENCES)]
    return reduce(DataFrame.unionByName, [_audited(t, tables) for t in ruled])
