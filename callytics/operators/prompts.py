"""Playbook sections, guidance per stage and prompt tables built in bulk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from callytics.functions.text import strip
from callytics.operators.transcripts import (
    ASK_WINDOW_MS,
    COPILOT_TURNS,
    COPILOT_WINDOW_MS,
    NO_TRANSCRIPT,
    excerpts_at,
)
from callytics.plans.intervals import stabbed
from callytics.sources.schemas import STAGES

# Playbook headings used for every stage, before and after those of the stage.
COMMON_BEFORE = (
    "Rol central del Co-Pilot",
    "Personalidad del Co-Pilot",
    "Reglas de comportamiento en tiempo real",
    "Framework de llamada",
)
COMMON_AFTER = ("Checklist de avance por etapa", "Formato ideal de respuesta", "Principios finales")
STAGE_HEADINGS = {
    "opening": ("Etapa opening",),
    "discovery": ("Etapa discovery",),
    "presentation": ("Etapa presentation",),
    "objection_handling": ("Etapa objection_handling", "Manejo de desviaciones del guion"),
    "closing": ("Etapa closing",),
    "follow_up": ("Etapa follow_up", "Manejo de desviaciones del guion"),
    "idle": ("Prompt maestro",),
    "ended": ("Principios finales",),
}
SECTION_RULE = "\n\n---\n\n"
GUIDANCE_CHARS = 5_200

# Texts of the user prompts.
NO_KEYWORDS = "(ninguna)"
NO_GUIDANCE = "(sin perfil operativo disponible)"
COPILOT_PROMPT = """[ESTADO DE LA LLAMADA]
Etapa: %s
Señal: %s
Motivo: %s
Keywords: %s

[TRANSCRIPT RECIENTE]
%s

[FUENTE OPERATIVA UNICA]
%s

Usa exclusivamente la fuente operativa anterior, la etapa detectada y el transcript reciente para decidir que debe hacer el agente ahora.
Genera solo UNA frase lista para decir al cliente."""
ASK_PROMPT = """[TRANSCRIPT RECIENTE - últimos 5 minutos]
%s

[PREGUNTA DEL AGENTE]
%s"""


def playbook_sections(docs: DataFrame) -> DataFrame:
    """All `##` and `###` sections of (doc, markdown): part, subpart, level, heading, body.

    A section reaches to the next heading of its own or a higher level. (part, subpart) is
    its place in the document. Every row is split by itself, without a shuffle. The outer form
    of explode keeps Spark from splitting a second time just to test for emptiness.
    """
    parts = docs.select("doc", F.posexplode_outer(F.split("markdown", r"(?<=\n)(?=#{1,2} )")).alias("part", "_part"))
    pieces = F.split("_part", r"(?<=\n)(?=### )")
    # The first piece of a part opens with the part's own heading and stands for all of it.
    first = F.when(F.col("_part").startswith("## "), F.col("_part")).otherwise(F.get("_pieces", F.lit(0)))
    rest = F.slice("_pieces", 2, F.greatest(F.size("_pieces") - 1, F.lit(0)))
    bodies = (
        parts.withColumn("_pieces", pieces)
        .withColumn("_bodies", F.concat(F.array(first), rest))
        .select("doc", "part", F.posexplode_outer("_bodies").alias("subpart", "_body"))
    )
    level = F.when(F.col("_body").startswith("## "), 2).when(F.col("_body").startswith("### "), 3)
    return (
        bodies.withColumn("level", level)
        .filter(F.col("level").isNotNull())
        .select(
            "doc",
            "part",
            "subpart",
            "level",
            F.substr(F.substring_index("_body", "\n", 1), F.col("level") + 2).alias("heading"),
            strip(F.col("_body")).alias("body"),
        )
    )


def section_map(
    stage_headings: Mapping[str, Sequence[str]] = STAGE_HEADINGS,
    before: Sequence[str] = COMMON_BEFORE,
    after: Sequence[str] = COMMON_AFTER,
) -> list[tuple[str, int, str]]:
    """(stage, position, heading phrase) for every stage, in the order of the guidance text."""
    return [
        (stage, position, phrase)
        for stage in STAGES
        for position, phrase in enumerate([*before, *stage_headings.get(stage, ()), *after])
    ]


def stage_guidance(
    sections: DataFrame,
    wanted: Sequence[tuple[str, int, str]] | None = None,
    max_chars: int = GUIDANCE_CHARS,
) -> DataFrame:
    """(doc, stage, guidance): the wanted sections of each stage, first match per phrase.

    Only documents with at least one wanted section give rows.
    """
    wanted = section_map() if wanted is None else wanted
    phrases = list(dict.fromkeys(phrase for _, _, phrase in wanted))
    listed = F.array(*[F.lit(p) for p in phrases])
    matched = F.filter(listed, lambda p: F.contains(F.col("heading"), p))
    firsts = (
        sections.withColumn("phrase", F.explode(matched))
        .groupBy("doc", "phrase")
        .agg(F.min(F.struct("part", "subpart", "body"))["body"].alias("body"))
    )
    places = {p: [(s, n) for s, n, q in wanted if q == p] for p in phrases}
    uses = F.coalesce(
        *[
            F.when(
                F.col("phrase") == p,
                F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(n).alias("position")) for s, n in used]),
            )
            for p, used in places.items()
        ]
    )
    placed = firsts.select("doc", "body", F.inline(uses))
    # At most one body per wanted phrase, so a group is as small as the section map.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda s: s["body"])
    text = F.array_join(F.filter(ordered, lambda b: b != ""), SECTION_RULE)
    return placed.groupBy("doc", "stage").agg(F.substring(strip(text), 1, max_chars).alias("guidance"))


def _or_else(text: Column, fallback: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.lit(fallback))


def copilot_prompts(
    signals: DataFrame, excerpts: DataFrame, guidance: DataFrame, system_prompt: str
) -> DataFrame:
    """One prompt row per signal. `signals` and `excerpts` share request_id; `guidance` is
    (stage, guidance) of one playbook, and `system_prompt` the caller's own fixed text."""
    # One row per stage, eight at most, of at most GUIDANCE_CHARS characters each.
    per_stage = guidance.groupBy("stage").agg(F.min("guidance").alias("guidance"))
    return (
        signals.join(excerpts, "request_id", "left")
        .join(F.broadcast(per_stage), "stage", "left")
        .withColumn("transcript_excerpt", F.coalesce("excerpt", F.lit(NO_TRANSCRIPT)))
        .select(
            "request_id",
            "session_id",
            F.col("signal_type").alias("trigger_type"),
            "stage",
            "matched_keywords",
            F.lit(system_prompt).alias("system_prompt"),
            F.format_string(
                COPILOT_PROMPT,
                F.col("stage"),
                F.col("signal_type"),
                F.col("reason"),
                _or_else(F.array_join("matched_keywords", ", "), NO_KEYWORDS),
                F.col("transcript_excerpt"),
                _or_else(F.col("guidance"), NO_GUIDANCE),
            ).alias("user_prompt"),
            "transcript_excerpt",
        )
    )


def copilot_excerpts(requests: DataFrame, turns: DataFrame, zone: str = "UTC") -> DataFrame:
    """Excerpts for prompts: three minutes back, the last sixteen turns."""
    return excerpts_at(requests, turns, COPILOT_WINDOW_MS, COPILOT_TURNS, zone)


#: Sessions last some hours: 2**23 ms. Longer ones are made up of several such blocks.
SESSION_LEVELS = 23


def active_sessions(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """`questions` (agent_id, asked_at ...) with the agent's session that was open then, session_id null without one.

    Of sessions that overlap the one that began last counts, of those the greatest id.
    """
    lasting = sessions.select(
        "agent_id", F.unix_millis("started_at").alias("start"), F.unix_millis("ended_at").alias("end"), F.col("id").alias("session_id")
    )
    asked = questions.withColumn("_at", F.unix_millis("asked_at"))
    order = lasting.select("agent_id", "start", "session_id", "end")
    return stabbed(asked, order, ["agent_id"], "_at", SESSION_LEVELS).select(*questions.columns, "session_id")


def ask_prompts(
    questions: DataFrame, turns: DataFrame, sessions: DataFrame, system_prompt: str, zone: str = "UTC"
) -> DataFrame:
    """One prompt per question (request_id, agent_id, question, asked_at).

    The question goes to the agent's open session, and the transcript of its last five minutes is used; a question without
    an open session has none.
    """
    asked = active_sessions(questions, sessions)
    known = asked.filter("session_id is not null").select("request_id", "session_id", F.unix_millis("asked_at").alias("at"))
    texts = excerpts_at(known, turns, ASK_WINDOW_MS, None, zone)
    excerpt = F.coalesce("excerpt", F.lit(NO_TRANSCRIPT))
    return asked.join(texts, "request_id", "left").select(
        "request_id",
        "session_id",
        F.lit(system_prompt).alias("system_prompt"),
        F.format_string(ASK_PROMPT, excerpt, F.col("question")).alias("user_prompt"),
    )
