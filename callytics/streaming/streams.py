"""Streaming forms of the operators: streaming DataFrame in, streaming DataFrame out.

Stateful streams need the RocksDB state store (`prepare_streaming`). Each key is served
by one task, so hot keys are bounded by the intake limit of the source.

No row is dropped for being late. The watermark only moves the timers on: it stands on a second
copy of each row without its texts (a tick), which Spark may drop when late, while the row itself
carries no event time and always reaches its key's state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from callytics.functions.time import ms_to_timestamp
from callytics.operators import stages, transcripts
from callytics.session import prepare
from callytics.sources.schemas import CLOCK_IN, KEYWORD_GROUPS
from callytics.streaming.processors import (
    ClockState,
    RecentState,
    SilenceState,
    StageState,
    TranscriptState,
)

DELAY = "10 seconds"

# Fixed value: buffered turns are lost this long after the last one.
BUFFER_TTL_SECONDS = 3_600

STREAMING_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def prepare_streaming(spark: SparkSession) -> SparkSession:
    for key, value in STREAMING_SETTINGS.items():
        spark.conf.set(key, value)
    return prepare(spark)


def _stateful(df: DataFrame, key: str, processor, schema: str, time_mode: str = "EventTime") -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode
    )


def _timed(df: DataFrame, key: str, at: Column, delay: str) -> DataFrame:
    """The rows without event time, and their ticks, which move the watermark.

    Done per input, so that time moves on with the slower one of two inputs.
    """
    narrow = [f.name for f in df.schema.fields if f.name == key or f.dataType.typeName() != "string"]
    ticks = df.select(*narrow, at.alias("event_time")).withWatermark("event_time", delay).withColumn("tick", F.lit(True))
    rows = df.withColumn("event_time", F.lit(None).cast("timestamp")).withColumn("tick", F.lit(False))
    return ticks.unionByName(rows, allowMissingColumns=True)


def _by_event_time(df: DataFrame, delay: str) -> DataFrame:
    """Rows of sessions with a `ts` in milliseconds, and their ticks."""
    return _timed(df, "session_id", ms_to_timestamp(F.col("ts")), delay)


def stream_clock(attempts: DataFrame) -> DataFrame:
    """Judged attempts, as `clock_validate`; judged in order of arrival across micro-batches."""
    asked = attempts.select(
        "id", "agent_id", "display_name", "action", F.unix_micros("event_at").alias("us")
    )
    schema = (
        "id bigint, agent_id string, display_name string, action string, us bigint, accepted boolean, "
        "error string, last_action string, last_us bigint"
    )
    judged = _stateful(asked, "agent_id", ClockState(), schema, "None")
    return judged.select(
        "id",
        "agent_id",
        "display_name",
        "action",
        F.timestamp_micros("us").alias("event_at"),
        "accepted",
        "error",
        "last_action",
        F.timestamp_micros("last_us").alias("last_at"),
    )


def live_status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Last action of every agent, its time and whether the agent is clocked in, from the state of `stream_clock`.

    The state itself is read, as of the last micro-batch that was committed, so no table of it is kept beside it.
    `checkpoint` is the folder the stream was started with.
    """
    prepare_streaming(spark)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    return state.select(
        F.col("key.agent_id").alias("agent_id"),
        (F.col("value.action") == CLOCK_IN).alias("clocked_in"),
        F.col("value.action").alias("last_action"),
        F.timestamp_micros("value.at").alias("last_at"),
    )


def stream_stages(
    turns: DataFrame,
    starts: DataFrame | None = None,
    groups: stages.Groups = KEYWORD_GROUPS,
    ttl_seconds: int = stages.STAGE_TTL_SECONDS,
    delay: str = DELAY,
) -> DataFrame:
    """Turns with previous_stage, stage and changed, as `stage_progression_ttl`.

    `starts` (id, started_at) is the stream of new sessions. Filter `changed` for change
    events; `stages.signals` applies to the result as it is.
    """
    said = _by_event_time(turns.select("session_id", "seq", "ts", "speaker", "text"), delay)
    ranked = stages._ranked(said, groups)
    if starts is not None:
        begun = starts.select(
            F.col("id").alias("session_id"),
            F.lit(-1).cast("long").alias("seq"),
            F.unix_millis("started_at").alias("ts"),
        )
        ranked = ranked.unionByName(_by_event_time(begun, delay), allowMissingColumns=True)
    ranked = ranked.withColumn("rank", F.coalesce("_rank", F.lit(0))).drop("_rank")
    schema = (
        "session_id string, seq bigint, ts bigint, speaker string, text string, previous_rank int, stage_rank int"
    )
    staged = _stateful(ranked, "session_id", StageState(ttl_seconds * 1000), schema)
    return staged.filter(F.col("seq") >= 0).select(
        "session_id",
        "seq",
        "ts",
        "speaker",
        "text",
        stages.stage_name(F.col("previous_rank")).alias("previous_stage"),
        stages.stage_name(F.col("stage_rank")).alias("stage"),
        (F.col("stage_rank") != F.col("previous_rank")).alias("changed"),
    )


def stream_silence(
    heartbeats: DataFrame,
    gap_seconds: int = transcripts.SILENCE_SECONDS,
    delay: str = DELAY,
) -> DataFrame:
    """(session_id, outcome, at): `closed` at the end of the first gap, `rejected` for later frames.

    A closed session stays closed. Frames older than the last one of an open session change nothing.
    """
    frames = _timed(heartbeats.select("session_id", "ts", F.unix_micros("ts").alias("us")), "session_id", F.col("ts"), delay)
    frames = frames.select("session_id", "event_time", "tick", "us")
    processor = SilenceState(gap_seconds * 1000)
    told = _stateful(frames, "session_id", processor, "session_id string, outcome string, us bigint")
    return told.select("session_id", "outcome", F.timestamp_micros("us").alias("at"))


def stream_recent(
    turns: DataFrame,
    window_ms: int = transcripts.COPILOT_WINDOW_MS,
    max_turns: int | None = transcripts.COPILOT_TURNS,
    zone: str = "UTC",
    delay: str = DELAY,
) -> DataFrame:
    """The excerpt as it stands after every turn."""
    lines = turns.select("session_id", "seq", "ts", transcripts._line(zone).alias("line"))
    schema = "session_id string, seq bigint, ts bigint, excerpt string"
    return _stateful(_by_event_time(lines, delay), "session_id", RecentState(window_ms, max_turns), schema)


def stream_transcripts(
    turns: DataFrame,
    ends: DataFrame,
    ttl_seconds: int = BUFFER_TTL_SECONDS,
    delay: str = DELAY,
) -> DataFrame:
    """Turns with their outcome: stored at the end of the session, expired or late.

    `ends` is a stream of (session_id, ended_at). The `stored` rows are the transcript, the
    others a side table. An ended session stays ended.
    """
    said = turns.select(
        "session_id", "seq", "speaker", "channel", "text", "ts", F.lit(False).alias("ends")
    )
    ended = ends.select(
        "session_id", F.unix_millis("ended_at").alias("ts"), F.lit(True).alias("ends")
    )
    both = _by_event_time(said, delay).unionByName(_by_event_time(ended, delay), allowMissingColumns=True)
    processor = TranscriptState(ttl_seconds * 1000)
    schema = (
        "session_id string, seq bigint, speaker string, channel smallint, text string, ts bigint, outcome string"
    )
    return _stateful(both, "session_id", processor, schema)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to Parquet, exactly once per checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()
