"""Schemas, enumerations and default vocabularies of the call-centre model."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Table schemas.
TABLES: dict[str, str] = {
    "users": "agent_id string, username string, avatar string, created_at timestamp, updated_at timestamp",
    "sessions": (
        "id string, agent_id string, agent_name string, status string, "
        "started_at timestamp, ended_at timestamp"
    ),
    "transcript_turns": (
        "session_id string, seq bigint, speaker string, channel smallint, text string, ts bigint"
    ),
    "questions": "id bigint, session_id string, question string, answer string, asked_at timestamp",
    "clock_events": (
        "id bigint, agent_id string, display_name string, action string, event_at timestamp, "
        "sheets_synced boolean, sheets_error string"
    ),
    "copilot_suggestions": (
        "id bigint, session_id string, trigger_type string, stage string, matched_keywords array<string>, "
        "transcript_excerpt string, suggestion string, source string, accepted boolean, shown_at timestamp"
    ),
    "copilot_request_logs": (
        "id bigint, session_id string, suggestion_id bigint, provider string, model string, "
        "trigger_type string, stage string, system_prompt string, user_prompt string, "
        "transcript_excerpt string, response_text string, error string, latency_ms int, created_at timestamp"
    ),
    "companies": "id bigint, code string, name string, active boolean, created_at timestamp",
    "products": (
        "id bigint, company_id bigint, code string, name string, active boolean, created_at timestamp"
    ),
    "followup_codes": "code string, label string, active boolean",
    "sales": (
        "id bigint, discord_interaction_id string, discord_message_id string, discord_guild_id string, "
        "discord_channel_id string, agent_id string, agent_name string, company_id bigint, "
        "product_id bigint, client_name string, amount_cents bigint, currency string, "
        "billing_period string, signature_status string, signature_date date, followup_code string, "
        "raw_text string, notes string, sold_at timestamp, created_at timestamp, updated_at timestamp"
    ),
}

# Enumerations.
CLOCK_IN, CLOCK_OUT = "CLOCKIN", "CLOCKOUT"
AGENT, CLIENT = "agente", "cliente"
ACTIVE, ENDED = "active", "ended"
BILLING_PERIODS = ("once", "month", "year")
SIGNATURE_STATUSES = ("IMM", "UW", "DATE")
SUGGESTION_SOURCES = ("gpt_api", "openclaw", "playbook")

# Call stages in order; the rank of a stage is its position.
STAGES = (
    "idle",
    "opening",
    "discovery",
    "presentation",
    "objection_handling",
    "closing",
    "follow_up",
    "ended",
)

# Follow-up codes a new installation starts with.
FOLLOWUP_CODES = (
    ("IMM", "Firmado en el momento", True),
    ("UW", "Underwriting", True),
)

# Default keyword groups, in matching order. Callers may pass their own.
KEYWORD_GROUPS: dict[str, tuple[str, ...]] = {
    "opening": (
        "buenos días", "buenas tardes", "buenas noches", "cómo está", "como esta", "mi nombre es",
        "le llamo de", "gracias por tomar la llamada", "recibí su solicitud", "recibi su solicitud",
        "usted pidió información", "usted pidio informacion", "vio el anuncio", "vio un anuncio",
    ),
    "discovery": (
        "familia", "hijos", "ingresos", "retiro", "ahorro", "beneficiario", "prioridad",
        "protección familiar", "proteccion familiar", "presupuesto", "meta", "objetivo", "retiro",
        "inversión", "inversion", "casa", "negocio", "qué le llamó la atención",
        "que le llamo la atencion", "qué fue lo que vio", "que fue lo que vio",
        "qué tiene actualmente", "que tiene actualmente", "por qué ahora", "por que ahora",
        "qué lo ha detenido", "que lo ha detenido", "plan actual", "seguro de vida",
        "depende de usted", "dependen de usted",
    ),
    "product": (
        "iul", "indexed universal life", "seguro de vida indexado", "cash value", "valor en efectivo",
        "death benefit", "beneficio por muerte", "prima", "premium", "cap rate", "floor", "rider",
        "póliza", "poliza", "póliza de vida", "poliza de vida", "seguro permanente",
        "vida universal indexada", "acumulación", "acumulacion", "protección de vida",
        "proteccion de vida", "s&p 500", "sp500", "índice", "indice",
    ),
    "objections": (
        "solo quería información", "solo queria informacion", "nomás quería información",
        "nomas queria informacion", "nada más quería información", "nada mas queria informacion",
        "mándame información", "mandame informacion", "mándeme información", "mandeme informacion",
        "envíame información", "enviame informacion", "me manda algo", "me mandas algo",
        "cuánto cuesta", "cuanto cuesta", "qué cuesta", "que cuesta", "cuál es el precio",
        "cual es el precio", "precio", "no tengo dinero", "no tengo presupuesto", "está caro",
        "esta caro", "muy caro", "lo voy a pensar", "dejeme pensarlo", "déjeme pensarlo", "lo reviso",
        "lo reviso después", "lo reviso despues", "después vemos", "despues vemos", "no me interesa",
        "ya tengo seguro", "ya tengo aseguranza", "necesito hablar con mi esposa",
        "necesito hablar con mi esposo", "hablar con mi pareja", "lo tengo que hablar",
        "lo quiero consultar", "no confío", "no confio", "no entiendo", "no estoy seguro",
        "no estoy segura", "no sé", "no se", "depende", "no es prioridad", "ahorita no",
    ),
    "risk": (
        "garantizado", "rendimiento seguro", "sin riesgo", "inversión garantizada",
        "inversion garantizada", "te vas a hacer rico", "ganancia garantizada", "siempre crece",
        "todos califican", "aprobación garantizada", "aprobacion garantizada", "cobertura garantizada",
        "no puede perder", "no vas a perder",
    ),
    "closing": (
        "empezamos", "siguiente paso", "aplicación", "aplicacion", "firma", "cuenta bancaria",
        "fecha de nacimiento", "vamos a completar", "si califico", "si calificas", "si lo aprueban",
        "si te aprueban", "revisar si califica", "revisar si calificas", "qué le ves de malo",
        "que le ves de malo", "qué negativo", "que negativo", "avanzar", "aplicar", "aprobación",
        "aprobacion",
    ),
    "followUp": (
        "lo llamo después", "lo llamo despues", "qué día le queda bien", "que dia le queda bien",
        "agendamos", "le mando información", "le mando informacion", "seguimos mañana", "mañana",
        "manana", "la próxima semana", "la proxima semana", "otro día", "otro dia", "mejor luego",
        "lo vemos luego",
    ),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
