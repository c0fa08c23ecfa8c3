"""Golden inputs with known results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from callytics.functions.signature import parse_signature
from callytics.sources.tables import conform

# Thirty sales as (agent, company, product, amount, period, signature).
SALES = [
    (0, "AME", "IUL", 100, "month", "IMM"),
    (1, "AME", "EAG", 175, "month", "UW"),
    (2, "NLG", "IUL", 220, "month", "2026-06-20"),
    (3, "ETHOS", "WL", 80, "month", "IMM"),
    (4, "AME", "WL", 1200, "once", "UW"),
    (0, "NLG", "EAG", 65, "month", "IMM"),
    (1, "ETHOS", "IUL", 300, "month", "2026-06-21"),
    (2, "AME", "IUL", 150, "month", "IMM"),
    (0, "AME", "EAG", 250, "month", "IMM"),
    (3, "NLG", "WL", 180, "month", "UW"),
    (4, "ETHOS", "EAG", 95, "month", "IMM"),
    (1, "AME", "WL", 2000, "once", "2026-06-24"),
    (2, "ETHOS", "IUL", 275, "month", "IMM"),
    (3, "AME", "EAG", 130, "month", "UW"),
    (0, "NLG", "IUL", 400, "month", "IMM"),
    (4, "NLG", "EAG", 75, "month", "2026-06-25"),
    (1, "AME", "IUL", 190, "month", "IMM"),
    (2, "ETHOS", "WL", 110, "month", "UW"),
    (3, "ETHOS", "EAG", 350, "month", "IMM"),
    (0, "AME", "WL", 1600, "once", "2026-06-28"),
    (1, "NLG", "IUL", 210, "month", "IMM"),
    (4, "AME", "EAG", 140, "month", "IMM"),
    (2, "NLG", "WL", 70, "month", "UW"),
    (3, "AME", "IUL", 165, "month", "2026-06-30"),
    (0, "ETHOS", "IUL", 500, "month", "IMM"),
    (1, "ETHOS", "WL", 125, "month", "IMM"),
    (2, "AME", "WL", 900, "once", "UW"),
    (4, "NLG", "EAG", 320, "month", "IMM"),
    (0, "AME", "IUL", 225, "month", "UW"),
    (3, "ETHOS", "EAG", 260, "month", "IMM"),
]
COMPANIES = ["AME", "NLG", "ETHOS"]
PRODUCTS = ["IUL", "EAG", "WL"]

# A Spanish call as (speaker, text, stage after it, changed, signal, matches).
CALL = [
    ("agente", "Buenos días, mi nombre es Laura", "opening", False, None, None),
    ("cliente", "Quiero proteger a mi familia y mis hijos", "discovery", True, None, None),
    ("agente", "La póliza acumula valor en efectivo", "presentation", True, None, None),
    ("cliente", "Está caro, lo voy a pensar", "objection_handling", True, "objection_detected",
     ["está caro", "lo voy a pensar"]),
    ("agente", "Es sin riesgo, se lo prometo", "objection_handling", False, "risk_detected", ["sin riesgo"]),
    ("cliente", "Bueno, ¿cuál es el siguiente paso?", "closing", True, "closing_opportunity", ["siguiente paso"]),
    ("agente", "Su retiro es importante", "closing", False, None, None),
    ("cliente", "Depende de usted", "objection_handling", True, "objection_detected", ["depende"]),
    ("agente", "Mañana lo llamo", "follow_up", True, None, None),
    ("cliente", "Gracias", "follow_up", False, None, None),
]

DAY_FROM, DAY_TO, DAY_NOW = "2026-01-02T00:00:00Z", "2026-01-03T00:00:00Z", "2026-01-10T00:00:00Z"

# Attendance cases as agent -> [(name, action, time)].
CLOCK_CASES = {
    "inside": [("i", "CLOCKIN", "2026-01-02 08:00:00"), ("i", "CLOCKOUT", "2026-01-02 16:30:00")],
    "start": [("s", "CLOCKIN", "2026-01-01 22:00:00"), ("s", "CLOCKOUT", "2026-01-02 02:00:00")],
    "end": [("e", "CLOCKIN", "2026-01-02 23:00:00"), ("e", "CLOCKOUT", "2026-01-03 05:00:00")],
    "open": [("o", "CLOCKIN", "2026-01-02 20:00:00")],
    "before": [("b", "CLOCKIN", "2026-01-01 08:00:00"), ("b", "CLOCKOUT", "2026-01-01 10:00:00")],
    "edge": [("g", "CLOCKIN", "2026-01-01 20:00:00"), ("g", "CLOCKOUT", "2026-01-02 00:00:00")],
    "half": [("h", "CLOCKIN", "2026-01-02 08:00:00"), ("h", "CLOCKOUT", "2026-01-02 08:02:30")],
    "renamed": [
        ("A", "CLOCKIN", "2026-01-02 08:00:00"),
        ("A", "CLOCKOUT", "2026-01-02 09:00:00"),
        ("B", "CLOCKIN", "2026-01-02 10:00:00"),
        ("B", "CLOCKOUT", "2026-01-02 12:00:00"),
    ],
}


def catalog(spark):
    companies = [(i + 1, code, code, True) for i, code in enumerate(COMPANIES)]
    products = [
        (3 * c + p + 1, c + 1, code, code, True)
        for c in range(len(COMPANIES))
        for p, code in enumerate(PRODUCTS)
    ]
    return (
        spark.createDataFrame(companies, "id bigint, code string, name string, active boolean"),
        spark.createDataFrame(
            products, "id bigint, company_id bigint, code string, name string, active boolean"
        ),
    )


def sales(spark):
    """Row i is sold at 2026-06-(1 + i mod 16), 10 + i mod 8 o'clock, quarter past."""
    rows = []
    for i, (agent, company, product, amount, period, signature) in enumerate(SALES):
        c, p = COMPANIES.index(company), PRODUCTS.index(product)
        rows.append(
            (
                i + 1, f"m{i + 1}", f"{agent + 1:03d}", f"Agent {agent + 1}", c + 1, 3 * c + p + 1,
                f"Client {i + 1}", amount * 100, period, signature,
                f"2026-06-{1 + i % 16:02d} {10 + i % 8:02d}:15:00",
            )
        )
    df = spark.createDataFrame(
        rows,
        "id bigint, discord_message_id string, agent_id string, agent_name string, company_id bigint, "
        "product_id bigint, client_name string, amount_cents bigint, billing_period string, "
        "signature string, sold_at string",
    )
    return conform(
        parse_signature(df, "signature").withColumns(
            {
                "currency": F.lit("USD"),
                "notes": F.lit("mock_dashboard_seed"),
                "created_at": F.col("sold_at"),
                "updated_at": F.col("sold_at"),
            }
        ),
        "sales",
    )


def call(spark, pause_at=None, pause_ms=0, session="s1"):
    """The call as turns 10 s apart, optionally with a pause before one of them."""
    rows, ts = [], 1_767_312_000_000
    for seq, (speaker, text, *_) in enumerate(CALL):
        ts += pause_ms if seq == pause_at else 10_000
        rows.append((session, seq, speaker, 0 if speaker == "agente" else 1, text, ts))
    return spark.createDataFrame(
        rows, "session_id string, seq bigint, speaker string, channel smallint, text string, ts bigint"
    )


def clock_rows():
    out, number = [], 0
    for agent, events in CLOCK_CASES.items():
        for name, action, at in events:
            number += 1
            out.append((number, agent, name, action, datetime.fromisoformat(at), False, None))
    return out


def clock_events(spark, rows=None):
    df = spark.createDataFrame(
        rows if rows is not None else clock_rows(),
        "id bigint, agent_id string, display_name string, action string, event_at timestamp_ntz, "
        "sheets_synced boolean, sheets_error string",
    )
    return df.withColumn("event_at", F.col("event_at").cast("timestamp"))
