"""Responses to prompts, their logs and the agents' feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callytics.functions.text import strip
from callytics.functions.time import Instant, instant

# The suggestion given when no model is asked, and its source.
PLAYBOOK_SOURCE = "playbook"
PLAYBOOK_SENTENCE = (
    "Para asegurarme de darle una recomendación correcta, ¿qué parte le gustaría aclarar primero: "
    "costo, beneficios o cómo funciona la póliza?"
)


def clean_response(text: Column) -> Column:
    """Drop one outer single quote per end, then one outer double quote, then outer space."""
    text = F.regexp_replace(text, r"^'|'\z", "")
    return strip(F.regexp_replace(text, r'^"|"\z', ""))


def response_clean(responses: DataFrame) -> DataFrame:
    return responses.withColumn("response_text", clean_response(F.col("response_text")))


def playbook_suggestions(signals: DataFrame) -> DataFrame:
    """The fixed suggestion for every signal, without a model."""
    return signals.select(
        "session_id",
        F.col("signal_type").alias("trigger_type"),
        "stage",
        "matched_keywords",
        F.lit(PLAYBOOK_SENTENCE).alias("suggestion"),
        F.lit(PLAYBOOK_SOURCE).alias("source"),
        F.lit(None).cast("string").alias("model"),
    )


def suggestion_log(prompts: DataFrame, responses: DataFrame, now: Instant) -> tuple[DataFrame, DataFrame]:
    """(suggestions, logs) of answered prompts; a failed request is logged without suggestion.

    Both tables take the unique request id as their id, so they agree without a sequence.
    """
    answered = prompts.join(response_clean(responses), "request_id")
    succeeded = F.col("error").isNull()
    suggestions = answered.filter(succeeded).select(
        F.col("request_id").alias("id"),
        "session_id",
        "trigger_type",
        "stage",
        "matched_keywords",
        "transcript_excerpt",
        F.col("response_text").alias("suggestion"),
        F.col("provider").alias("source"),
        F.lit(None).cast("boolean").alias("accepted"),
        instant(now).alias("shown_at"),
    )
    logs = answered.select(
        F.col("request_id").alias("id"),
        "session_id",
        F.when(succeeded, F.col("request_id")).alias("suggestion_id"),
        "provider",
        "model",
        "trigger_type",
        "stage",
        "system_prompt",
        "user_prompt",
        "transcript_excerpt",
        F.when(succeeded, F.col("response_text")).alias("response_text"),
        "error",
        "latency_ms",
        instant(now).alias("created_at"),
    )
    return suggestions, logs


def suggestion_feedback(
    suggestions: DataFrame, sessions: DataFrame, feedback: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(suggestions, rejected): feedback counts from the owner while the session is open.

    `feedback`: suggestion_id, agent_id, accepted, at. The last valid one wins.
    """
    owner = sessions.select(F.col("id").alias("session_id"), F.col("agent_id").alias("_owner"), "ended_at")
    asked = suggestions.select(F.col("id").alias("suggestion_id"), "session_id")
    judged = feedback.join(asked, "suggestion_id", "left").join(owner, "session_id", "left")
    opened = F.coalesce(F.col("at") < F.col("ended_at"), F.lit(True))
    owned = F.coalesce((F.col("_owner") == F.col("agent_id")) & opened, F.lit(False))
    judged = judged.withColumn(
        "reason", F.when(F.col("session_id").isNull(), "suggestion_not_found").when(~owned, "forbidden")
    )
    last = (
        judged.filter(F.col("reason").isNull())
        .groupBy(F.col("suggestion_id").alias("id"))
        .agg(F.max(F.struct("at", "accepted"))["accepted"].alias("_accepted"))
    )
    updated = suggestions.join(last, "id", "left").withColumn("accepted", F.coalesce("_accepted", "accepted"))
    rejected = judged.filter(F.col("reason").isNotNull()).select(*feedback.columns, "reason")
    return updated.select(*suggestions.columns), rejected
