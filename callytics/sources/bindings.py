"""The model's logical tables, derived from the given TPC-H-like Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callytics.functions.money import amount_to_cents
from callytics.functions.time import ms_to_timestamp
from callytics.operators import attendance, transcripts
from callytics.operators.sales_maintenance import RELOAD_TAG
from callytics.plans.slices import Spread, with_hot
from callytics.sources.schemas import AGENT, CLIENT, CLOCK_IN, CLOCK_OUT, FOLLOWUP_CODES
from callytics.sources.raw import load_raw, stream_raw

# The market segments of the customer table, in order.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

FIRST_TURN_MS = 1_704_067_200_000
SESSIONS_AS_OF = "2024-01-03T00:00:00Z"

# Words that occur in the given conversations, one small group per kind.
GROUPS = {
    "opening": ("tiontion",),
    "discovery": ("anble", "inble"),
    "product": ("enber",),
    "objections": ("nicht", "thored"),
    "risk": ("enung",),
    "closing": ("erlich",),
    "followUp": ("queci",),
}


Reader = Callable[[SparkSession, str, str], DataFrame]


def clock_attempts(spark: SparkSession, folder: str, read: Reader = load_raw) -> DataFrame:
    event, value = F.col("event_type"), F.col("value")
    return read(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("agent_id"),
        F.concat(F.lit("User#"), "user_id").alias("display_name"),
        F.when(event.isin("signup", "view"), CLOCK_IN).otherwise(CLOCK_OUT).alias("action"),
        F.col("ts").alias("event_at"),
        (value < 100).alias("sheets_synced"),
        F.when(value > 200, F.concat(F.lit("e"), event)).alias("sheets_error"),
    )


def event_spread(spark: SparkSession, folder: str) -> Spread:
    """Hot agents, counted on one column of the stored table."""
    ids = load_raw(spark, folder, "events").select(F.col("user_id").cast("string").alias("agent_id"))
    return with_hot(Spread(), ids, ["agent_id"])


def clock_events(spark: SparkSession, folder: str) -> DataFrame:
    return attendance.clock_events(clock_attempts(spark, folder), spread=event_spread(spark, folder))


def agents(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer key as an agent id; most have no clock events."""
    return load_raw(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("agent_id"))


def _product_id() -> Column:
    position = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))
    unknown = F.raise_error(F.concat(F.lit("unknown segment "), F.coalesce("c_mktsegment", F.lit("null")))).cast("long")
    return F.col("c_nationkey").cast("long") * 10 + F.when(position > 0, position).otherwise(unknown)


def companies(spark: SparkSession, folder: str) -> DataFrame:
    return load_raw(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.upper("n_name").alias("code"),
        F.concat(F.lit("Company "), "n_name").alias("name"),
        (F.col("n_regionkey") != 4).alias("active"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return (
        load_raw(spark, folder, "customer")
        .select("c_nationkey", "c_mktsegment")
        .distinct()
        .select(
            _product_id().alias("id"),
            F.col("c_nationkey").cast("long").alias("company_id"),
            F.col("c_mktsegment").alias("code"),
            F.initcap("c_mktsegment").alias("name"),
            (F.col("c_mktsegment") != "MACHINERY").alias("active"),
        )
    )


def followup_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FOLLOWUP_CODES), "code string, label string, active boolean")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    customers = load_raw(spark, folder, "customer")
    return load_raw(spark, folder, "orders").join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    signature = F.when(status == "F", "IMM").when(status == "P", "UW").otherwise("DATE")
    none = F.lit(None).cast("string")
    return _orders(spark, folder).select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("i"), "o_orderkey").alias("discord_interaction_id"),
        F.col("o_orderkey").cast("string").alias("discord_message_id"),
        none.alias("discord_guild_id"),
        none.alias("discord_channel_id"),
        F.col("c_custkey").cast("string").alias("agent_id"),
        F.col("c_name").alias("agent_name"),
        F.col("c_nationkey").cast("long").alias("company_id"),
        _product_id().alias("product_id"),
        F.col("c_name").alias("client_name"),
        amount_to_cents(F.col("o_totalprice")).alias("amount_cents"),
        F.lit("USD").alias("currency"),
        F.when(priority == "1-URGENT", "once")
        .when(priority == "2-HIGH", "year")
        .otherwise("month")
        .alias("billing_period"),
        signature.alias("signature_status"),
        F.when(status == "O", F.date_add(F.to_date("o_orderdate"), 7)).alias("signature_date"),
        F.when(status != "O", signature).alias("followup_code"),
        none.alias("raw_text"),
        F.when(priority == "3-MEDIUM", RELOAD_TAG).when(priority != "1-URGENT", priority).alias("notes"),
        F.col("o_orderdate").alias("sold_at"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def sales_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched sales at line level, for aggregates: brand as company, part type as product."""
    parts, suppliers = load_raw(spark, folder, "part"), load_raw(spark, folder, "supplier")
    return (
        load_raw(spark, folder, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_suppkey").cast("string").alias("agent_id"),
            F.col("s_name").alias("agent_name"),
            F.col("p_brand").alias("company_code"),
            F.col("p_brand").alias("company_name"),
            F.col("p_type").alias("product_code"),
            F.col("p_type").alias("product_name"),
            amount_to_cents(F.col("l_extendedprice")).alias("amount_cents"),
            F.col("l_shipdate").alias("sold_at"),
        )
    )


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Unclean sale requests: every rule of the ingestion is broken by some of them."""
    status, priority, segment = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("c_mktsegment")
    nations = load_raw(spark, folder, "nation").select("n_nationkey", "n_name")
    day = F.to_date("o_orderdate")
    kind = F.col("o_orderkey") % 5
    signature = (
        F.when(kind == 0, "imm")
        .when(kind == 1, " UW ")
        .when(kind == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 3, F.concat_ws("/", F.dayofmonth(day), F.month(day), F.year(day)))
        .otherwise("x")
    )
    none = F.lit(None).cast("string")
    return (
        _orders(spark, folder)
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            none.alias("discord_interaction_id"),
            F.when(priority != "1-URGENT", F.concat_ws("-", "o_custkey", F.year("o_orderdate"))).alias(
                "discord_message_id"
            ),
            none.alias("discord_guild_id"),
            none.alias("discord_channel_id"),
            F.col("c_custkey").cast("string").alias("agent_id"),
            F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("agent_name"),
            F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("company_code"),
            F.when((segment == "MACHINERY") & (priority == "2-HIGH"), " ")
            .otherwise(F.lower(segment))
            .alias("product_code"),
            F.when((segment == "BUILDING") & (priority == "2-HIGH"), "  ")
            .when((segment == "FURNITURE") & (priority == "2-HIGH"), "")
            .otherwise(F.concat(F.lit("  "), "c_name"))
            .alias("client_name"),
            F.when((priority == "4-NOT SPECIFIED") & (status == "P"), "n/a")
            .when((priority == "4-NOT SPECIFIED") & (status == "F"), "-1")
            .otherwise(F.col("o_totalprice").cast("string"))
            .alias("amount"),
            F.when(status == "O", " mxn ").alias("currency"),
            F.when((priority == "3-MEDIUM") & (status == "P"), "week")
            .when(priority == "3-MEDIUM", "year")
            .alias("billing_period"),
            signature.alias("signature_input"),
            none.alias("raw_text"),
            F.when((priority == "5-LOW") & (status == "F"), "yesterday")
            .when(status != "P", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .alias("sold_at"),
            none.alias("notes"),
        )
    )


def sale_patches(spark: SparkSession, folder: str) -> DataFrame:
    """A new price for low-priority sales, a clean-up of others, and a sale that does not exist."""
    orders = load_raw(spark, folder, "orders")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    none = F.lit(None).cast("string")
    known = orders.filter(priority.isin("5-LOW", "2-HIGH")).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("patched_at"),
        F.when(priority == "2-HIGH", " nation_99 ").alias("company_code"),
        none.alias("product_code"),
        F.when(status == "P", " New client ").when(status == "F", " ").alias("client_name"),
        F.when(priority == "5-LOW", (F.col("o_totalprice") * 2).cast("string")).alias("amount"),
        none.alias("currency"),
        none.alias("billing_period"),
        F.when(priority == "2-HIGH", "uw").alias("signature_input"),
        F.lit(None).cast("timestamp").alias("sold_at"),
        none.alias("notes"),
        (priority == "5-LOW").alias("notes_set"),
    )
    unknown = orders.agg((F.max("o_orderkey") + 1).alias("id"), F.max("o_orderdate").alias("patched_at"))
    return known.unionByName(unknown, allowMissingColumns=True)


def _turn_ms() -> Column:
    return F.lit(FIRST_TURN_MS) + F.col("conv_id") * 3_600_000 + F.col("turn") * 45_000


def turns(spark: SparkSession, folder: str, read: Reader = load_raw) -> DataFrame:
    """Every line as a turn; only the user is the client."""
    client = F.col("role") == "user"
    return read(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("seq"),
        F.when(client, CLIENT).otherwise(AGENT).alias("speaker"),
        F.when(client, 1).otherwise(0).cast("short").alias("channel"),
        "text",
        _turn_ms().alias("ts"),
    )


def stt_results(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as speech-to-text payloads; empty results and a missing channel included."""
    said = turns(spark, folder)
    channel = F.when(F.col("seq") > 0, F.array(F.col("channel").cast("int")))
    text = F.when(F.col("text").contains("nicht"), F.lit("  ")).otherwise(
        F.concat(F.lit(" "), "text", F.lit(" "))
    )
    alternatives = F.array(F.struct(text.alias("transcript")))
    payload = F.struct(channel.alias("channel_index"), F.struct(alternatives.alias("alternatives")).alias("channel"))
    return said.select("session_id", "seq", "ts", F.to_json(payload).alias("payload"))


def session_starts(spark: SparkSession, folder: str) -> DataFrame:
    said = turns(spark, folder)
    agent = (F.col("id").cast("long") % 10).cast("string")
    return said.groupBy(F.col("session_id").alias("id")).agg(
        ms_to_timestamp(F.min("ts")).alias("started_at")
    ).select(
        "id", agent.alias("agent_id"), F.concat(F.lit("Agent "), agent).alias("agent_name"), "started_at"
    )


def session_ends(spark: SparkSession, folder: str) -> DataFrame:
    """An explicit end at the last turn of every session with an even number."""
    said = turns(spark, folder).groupBy("session_id").agg(ms_to_timestamp(F.max("ts")).alias("ended_at"))
    return said.filter(F.col("session_id").cast("long") % 2 == 0)


def turn_heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).select("session_id", ms_to_timestamp(F.col("ts")).alias("ts"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    starts = session_starts(spark, folder)
    silence = transcripts.sessions_silence(starts, turn_heartbeats(spark, folder))
    return transcripts.sessions_close(starts, session_ends(spark, folder), silence, SESSIONS_AS_OF)


def streamed_starts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of session starts: the opening line of every conversation, whoever says it."""
    return stream_raw(spark, folder, "conversations").filter("turn = 0").select(
        F.col("conv_id").cast("string").alias("id"), ms_to_timestamp(_turn_ms()).alias("started_at")
    )


def streamed_ends(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of session ends: a second after the sixth line, where there is one."""
    return stream_raw(spark, folder, "conversations").filter("turn = 5").select(
        F.col("conv_id").cast("string").alias("session_id"),
        ms_to_timestamp(_turn_ms() + 1_000).alias("ended_at"),
    )


def event_heartbeats(spark: SparkSession, folder: str, read: Reader = load_raw) -> DataFrame:
    return read(spark, folder, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts")


def event_starts(spark: SparkSession, folder: str) -> DataFrame:
    return event_heartbeats(spark, folder).groupBy(F.col("session_id").alias("id")).agg(
        F.min("ts").alias("started_at")
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    long_ago = F.timestamp_seconds(F.lit(1_600_000_000))
    return load_raw(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("agent_id"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("avatar"),
        long_ago.alias("created_at"),
        long_ago.alias("updated_at"),
    )


def user_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A log-in per event; the shift of the ids makes some users new."""
    return load_raw(spark, folder, "events").select(
        (F.col("user_id") + 1400).cast("string").alias("agent_id"),
        F.concat("event_type", F.lit("#"), "user_id").alias("username"),
        F.when(F.col("value") < 100, F.col("event_type")).alias("avatar"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def sync_results(spark: SparkSession, folder: str) -> DataFrame:
    """Export outcomes: ok for sign-ups, an error for the others; dear events are tried again an hour later, and then the
    dearest succeed."""
    event, value = F.col("event_type"), F.col("value")
    once = F.struct(
        F.col("ts").alias("at"), (event == "signup").alias("ok"), F.when(event != "signup", F.concat(F.lit("failed "), event)).alias("error")
    )
    again = F.struct(
        (F.col("ts") + F.make_dt_interval(hours=F.lit(1))).alias("at"),
        (value >= 200).alias("ok"),
        F.when(value < 200, F.concat(F.lit("again "), event)).alias("error"),
    )
    tries = F.when(value >= 150, F.array(once, again)).otherwise(F.array(once))
    return load_raw(spark, folder, "events").select(F.col("event_id").alias("id"), F.inline(tries))


def turn_spread(spark: SparkSession, folder: str) -> Spread:
    """Hot sessions, counted on one column of the stored table."""
    ids = load_raw(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("session_id"))
    return with_hot(Spread(), ids, ["session_id"])


def request_id(session: str = "session_id") -> Column:
    return F.col(session).cast("long") * 1_048_576 + F.col("seq")


def manual_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A request a second after every turn, in every fifth session not by the owner, and one for an unknown session."""
    said = turns(spark, folder)
    session = F.col("session_id").cast("long")
    asked = said.select(
        request_id().alias("request_id"),
        "session_id",
        F.when(session % 5 == 0, "nobody").otherwise((session % 10).cast("string")).alias("agent_id"),
        (F.col("ts") + 1_000).alias("at"),
    )
    unknown = said.agg(
        F.lit(-1).cast("long").alias("request_id"), F.lit("none").alias("session_id"), F.lit("1").alias("agent_id"), F.max("ts").alias("at")
    )
    return asked.unionByName(unknown)


def agent_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of a client as a question of the agent a second later; some come from an agent without sessions."""
    session = F.col("session_id").cast("long")
    return turns(spark, folder).filter(F.col("speaker") == CLIENT).select(
        request_id().alias("request_id"),
        F.when(session % 7 == 0, "nobody").otherwise((session % 10).cast("string")).alias("agent_id"),
        F.col("text").alias("question"),
        ms_to_timestamp(F.col("ts") + 1_000).alias("asked_at"),
    )


def overlapping_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions, of which every third ends half a day late, in its agent's next one."""
    late = (F.col("id").cast("long") % 3 == 0) & F.col("ended_at").isNotNull()
    ended = F.when(late, F.col("ended_at") + F.make_dt_interval(hours=F.lit(12))).otherwise(F.col("ended_at"))
    return sessions(spark, folder).withColumn("ended_at", ended)


def playbook_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as playbooks: every line opens a section, some sentences a subsection."""
    text = F.regexp_replace("text", "\n", "\n## ")
    text = F.regexp_replace(text, r"\. (L|R|D)", ".\n### $1")
    return load_raw(spark, folder, "documents").select(
        F.col("doc_id").alias("doc"), F.concat(F.lit("# "), "source", F.lit("\n"), text).alias("markdown")
    )
