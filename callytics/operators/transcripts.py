"""Turns, sessions and transcript excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callytics.functions.text import strip
from callytics.functions.time import Instant, as_utc, instant, ms_to_timestamp
from callytics.plans import slices
from callytics.plans.keyed import latest_per_key
from callytics.sources.schemas import ACTIVE, AGENT, CLIENT, ENDED
from callytics.sources.tables import append_new

# Silence limit, recent windows, turns per excerpt, texts and formats.
SILENCE_SECONDS = 60
COPILOT_WINDOW_MS, ASK_WINDOW_MS = 180_000, 300_000
COPILOT_TURNS = 16
NO_TRANSCRIPT = "(sin transcript disponible)"
STT_PAYLOAD = "channel_index array<int>, channel struct<alternatives:array<struct<transcript:string>>>"

ORDER = ["ts", "seq"]


def turns_build(stt_results: DataFrame) -> DataFrame:
    """Turns from speech-to-text results (session_id, seq, ts, payload JSON)."""
    parsed = stt_results.withColumn("_p", F.from_json("payload", STT_PAYLOAD))
    index = F.coalesce(F.get("_p.channel_index", F.lit(0)), F.lit(0))
    text = strip(F.get("_p.channel.alternatives", F.lit(0))["transcript"])
    agent = F.col("_index") == 0
    return (
        parsed.withColumns({"_index": index, "text": text})
        .filter(F.col("text") != "")
        .select(
            "session_id",
            "seq",
            F.when(agent, AGENT).otherwise(CLIENT).alias("speaker"),
            F.when(agent, 0).otherwise(1).cast("short").alias("channel"),
            "text",
            "ts",
        )
    )


def sessions_silence(starts: DataFrame, heartbeats: DataFrame, gap_seconds: int = SILENCE_SECONDS) -> DataFrame:
    """(session_id, silence_at): the end of the first gap longer than `gap_seconds`.

    Frames of one gap-wide bucket are never a gap apart, so each bucket is reduced to
    its first and last frame before the shuffle. A session then holds one row per
    bucket, however many frames it sent.
    """
    frames = heartbeats.select("session_id", "ts").unionByName(
        starts.select(F.col("id").alias("session_id"), F.col("started_at").alias("ts"))
    )
    buckets = (
        frames.groupBy("session_id", slices.time_slice(F.col("ts"), gap_seconds).alias("_bucket"))
        .agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
        .withColumn(
            "_next", F.lead("_first").over(Window.partitionBy("session_id").orderBy("_bucket"))
        )
    )
    limit = F.col("_last") + F.make_dt_interval(secs=F.lit(gap_seconds))
    return (
        buckets.filter(F.col("_next").isNull() | (F.col("_next") > limit))
        .groupBy("session_id")
        .agg(F.min(limit).alias("silence_at"))
    )


def sessions_close(
    starts: DataFrame,
    ends: DataFrame,
    silence: DataFrame,
    as_of: Instant,
    spread: slices.Spread = slices.Spread(),
) -> DataFrame:
    """Sessions begun by `as_of`, ended by request, by silence or by the agent's next session."""
    starts = starts.filter(F.col("started_at") <= instant(as_of))
    first_end = ends.groupBy("session_id").agg(F.min("ended_at").alias("_asked"))
    sessions = slices.with_neighbours(
        starts,
        ["agent_id"],
        ["started_at", "id"],
        spread,
        lead={"_replaced": "started_at"},
    )
    joined = sessions.join(first_end.withColumnRenamed("session_id", "id"), "id", "left").join(
        silence.select(F.col("session_id").alias("id"), F.col("silence_at").alias("_silent")), "id", "left"
    )
    ended = F.least("_asked", "_replaced", "_silent")
    known = F.coalesce(ended <= instant(as_of), F.lit(False))
    return joined.select(
        "id",
        "agent_id",
        "agent_name",
        F.when(known, ENDED).otherwise(ACTIVE).alias("status"),
        "started_at",
        F.when(known, ended).alias("ended_at"),
    )


def transcript_flush(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """The buffered turns of ended sessions, as stored."""
    ended = sessions.filter(F.col("status") == ENDED).select(F.col("id").alias("session_id"))
    return turns.join(ended, "session_id", "left_semi").select(
        "session_id", "seq", "speaker", "channel", "text", "ts"
    )


def write_transcripts(flushed: DataFrame, path: str) -> None:
    """Store turns by day, each (session, seq) once."""
    append_new(flushed, path, ["session_id", "seq"], ms_to_timestamp(F.col("ts")))


def recent_turns(turns: DataFrame, as_of: Instant | DataFrame, window_ms: int) -> DataFrame:
    """Turns of the last `window_ms` before `as_of`, one instant or (session_id, as_of) rows."""
    if isinstance(as_of, DataFrame):
        at = as_of.select("session_id", F.unix_millis("as_of").alias("_at"))
        found = turns.join(at, "session_id")
        inside = (F.col("ts") >= F.col("_at") - window_ms) & (F.col("ts") <= F.col("_at"))
        return found.filter(inside).select(*turns.columns)
    end = int(as_utc(as_of).timestamp() * 1000)
    return turns.filter((F.col("ts") >= end - window_ms) & (F.col("ts") <= end))


def _line(zone: str) -> Column:
    clock = F.date_format(F.from_utc_timestamp(ms_to_timestamp(F.col("ts")), zone), "HH:mm:ss")
    return F.concat("speaker", F.lit(" ("), clock, F.lit("): "), "text")


def _joined(lines: Column, max_turns: int | None) -> Column:
    ordered = F.array_sort(lines)
    if max_turns is not None:
        first = F.greatest(F.size(ordered) - max_turns + 1, F.lit(1))
        ordered = F.slice(ordered, first, F.lit(max_turns))
    text = F.array_join(F.transform(ordered, lambda t: t["line"]), "\n")
    return F.coalesce(F.when(text != "", text), F.lit(NO_TRANSCRIPT))


def transcript_excerpt(
    turns: DataFrame, sessions: DataFrame, max_turns: int | None = COPILOT_TURNS, zone: str = "UTC"
) -> DataFrame:
    """One excerpt per session from its (already recent) turns; the last `max_turns` of them.

    Spark drops all but `max_turns` rows per session and task before the shuffle. Without
    `max_turns` the text holds all turns given, so give those of a short window.
    """
    kept = turns
    if max_turns is not None:
        newest = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("seq"))
        kept = turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= max_turns)
    lines = kept.select("session_id", F.struct(*ORDER, _line(zone).alias("line")).alias("_t"))
    texts = lines.groupBy("session_id").agg(_joined(F.collect_list("_t"), max_turns).alias("excerpt"))
    return (
        sessions.select(F.col("id").alias("session_id"))
        .join(texts, "session_id", "left")
        .select("session_id", F.coalesce("excerpt", F.lit(NO_TRANSCRIPT)).alias("excerpt"))
    )


def _asked_turns(requests: DataFrame, turns: DataFrame, window_ms: int, slice_seconds: int) -> DataFrame:
    """Turns in hours that some request reaches into; the others are dropped before any shuffle of texts."""
    hour = lambda ms: slices.ms_slice(ms, slice_seconds)
    reach = F.explode(F.sequence(hour(F.col("at") - window_ms), hour(F.col("at"))))
    asked = requests.select("session_id", reach.alias("_hour")).distinct()
    return turns.withColumn("_hour", hour(F.col("ts"))).join(asked, ["session_id", "_hour"], "left_semi")


def excerpts_at(
    requests: DataFrame,
    turns: DataFrame,
    window_ms: int,
    max_turns: int | None,
    zone: str = "UTC",
    slice_seconds: int = slices.HOUR,
    spread: slices.Spread = slices.Spread(),
) -> DataFrame:
    """(request_id, excerpt) of what was said in the `window_ms` before each request.

    `requests`: request_id (unique), session_id, at (ms). The turns of a session are numbered once, and for each request the
    turns before its window and those up to its time are counted in the same pass; it is then joined with the numbers
    between. So the work grows with the turns and the lines given out, however close turns follow each other.
    """
    said = _asked_turns(requests, turns, window_ms, slice_seconds).select(
        "session_id", "ts", F.lit(0).alias("_side"), "seq", _line(zone).alias("line"), F.lit(1).cast("long").alias("_turns")
    )
    mark = lambda ms, side: F.struct(ms.alias("ts"), F.lit(side).alias("_side"))
    marks = F.explode(F.array(mark(F.col("at") - window_ms, -1), mark(F.col("at"), 1)))
    asked = requests.select("session_id", "request_id", marks.alias("_m")).select("session_id", "request_id", "_m.*")
    asked = asked.withColumn("_turns", F.lit(0).cast("long"))
    keys, order = ["session_id"], ["ts", "_side", "seq", "request_id"]
    rows = slices.sliced(said.unionByName(asked, allowMissingColumns=True), keys, order, spread)
    hot, carry = slices.hot_only(rows), None
    if hot is not None:
        ends = hot.groupBy(*keys, slices.SLICE).agg(F.sum("_turns").alias("_turns"), F.min(F.struct(*order)).alias("_first"))
        earlier = F.sum("_turns").over(slices.before(slices.across(keys)))
        carry = ends.withColumn("_turns", earlier).filter("_turns is not null").select(
            *keys, slices.SLICE, "_first.ts", F.lit(-2).alias("_side"), "_turns"
        )
    running = F.sum("_turns").over(slices.upto(slices.inside(rows, keys, order)))
    counted = slices.without_carry(slices.with_carry(rows, carry).withColumn("_number", running))

    numbered = counted.filter("_side = 0").select("session_id", "_number", F.struct("ts", "seq", "line").alias("_t"))
    bound = lambda side: F.max(F.when(F.col("_side") == side, F.col("_number")))
    spans = counted.filter("_side <> 0").groupBy("request_id", "session_id").agg(bound(-1).alias("_low"), bound(1).alias("_high"))
    if max_turns is not None:
        spans = spans.withColumn("_low", F.greatest("_low", F.col("_high") - max_turns))
    numbers = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array().cast("array<bigint>"))
    wanted = spans.select("request_id", "session_id", F.explode_outer(numbers).alias("_number"))
    found = wanted.join(numbered, ["session_id", "_number"], "left").groupBy("request_id").agg(F.collect_list("_t").alias("_lines"))
    return found.select("request_id", _joined(F.col("_lines"), max_turns).alias("excerpt"))


def session_status(sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, active, session_id, started_at) from the newest open session."""
    opened = sessions.filter(F.col("status") == ACTIVE).select("agent_id", "started_at", "id")
    newest = latest_per_key(opened, ["agent_id"], ["started_at", "id"])
    return (
        agents.select("agent_id")
        .distinct()
        .join(newest, "agent_id", "left")
        .select(
            "agent_id",
            F.col("id").isNotNull().alias("active"),
            F.col("id").alias("session_id"),
            "started_at",
        )
    )
