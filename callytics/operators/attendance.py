"""Clock events: validation, status, shifts, summaries, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callytics.functions.time import (
    DEFAULT_ZONE,
    Instant,
    check_range,
    instant,
    local_time,
    micros_between,
    whole_minutes,
)
from callytics.plans import slices
from callytics.plans.keyed import latest_per_key
from callytics.plans.paging import clamp, page, with_total
from callytics.plans.slices import Spread
from callytics.sources.schemas import CLOCK_IN, CLOCK_OUT

# Limits of the range, page and history requests.
MAX_RANGE_DAYS = 90
PAGE_LIMIT, PAGE_DEFAULT = 500, 100
HISTORY_LIMIT, HISTORY_DEFAULT = 200, 50

KEYS = ["agent_id"]
ORDER = ["event_at", "id"]


def clock_validate(
    attempts: DataFrame, stored: DataFrame | None = None, spread: Spread = Spread()
) -> DataFrame:
    """Judge every attempt in order: +accepted, error, last_action, last_at.

    After any attempt the agent is in the state the attempt asked for, whether it
    was accepted or already so. An attempt is therefore accepted when it differs
    from the one before it, and the first must be a clock-in. `stored` gives the
    accepted events the attempts follow on.
    """
    rows = attempts.withColumn("_stored", F.lit(False))
    if stored is not None:
        base = latest_per_key(stored.select(*KEYS, *ORDER, "action"), KEYS, ORDER)
        rows = rows.unionByName(base.withColumn("_stored", F.lit(True)), allowMissingColumns=True)
    rows = slices.sliced(rows, KEYS, ORDER, spread)

    out = F.lit(CLOCK_OUT)
    window = slices.inside(rows, KEYS, ORDER)
    hot, carry = slices.hot_only(rows), None
    if hot is not None:
        edge = F.struct(*ORDER, "action", "_stored")
        turned = F.col("_stored") | (F.col("action") != F.lag("action").over(window))
        edges = (
            hot.withColumn("_turned", turned)
            .groupBy(*KEYS, slices.SLICE)
            .agg(
                F.min(edge).alias("_first"),
                F.max(edge).alias("_last"),
                # The first row of a slice counts below, once its predecessor is known.
                F.max(F.when(F.col("_turned"), F.col("event_at"))).alias("_turned_at"),
            )
        )
        order = slices.across(KEYS)
        first = F.col("_first")
        opened = first["_stored"] | (first["action"] != F.coalesce(F.lag("_last.action").over(order), out))
        carry = (
            edges.withColumn("_before", F.lag("_last").over(order))
            .withColumn("_since", F.coalesce("_turned_at", F.when(opened, first["event_at"])))
            .withColumn("_since", F.last("_since", ignorenulls=True).over(slices.before(order)))
            .filter(F.col("_before").isNotNull())
            .select(*KEYS, slices.SLICE, "_before.event_at", "_before.id", "_before.action", "_since")
        )
    rows = rows.withColumn("_since", F.lit(None).cast("timestamp"))

    previous = F.coalesce(F.lag("action").over(window), out)
    judged = (
        slices.with_carry(rows, carry)
        .withColumn("_previous", previous)
        .withColumn("accepted", F.col("_stored") | (F.col("action") != F.col("_previous")))
        .withColumn(
            "_since",
            F.when(F.col(slices.CARRY), F.col("_since")).when(F.col("accepted"), F.col("event_at")),
        )
        .withColumn("last_at", F.last("_since", ignorenulls=True).over(slices.before(window)))
    )
    refused = F.when(F.col("action") == CLOCK_IN, F.lit("already_clocked_in")).otherwise(
        F.lit("not_clocked_in")
    )
    judged = slices.without_carry(judged).filter(~F.col("_stored"))
    return judged.select(
        *attempts.columns,
        "accepted",
        F.when(~F.col("accepted"), refused).alias("error"),
        F.when(F.col("last_at").isNotNull(), F.col("_previous")).alias("last_action"),
        "last_at",
    )


def clock_events(
    attempts: DataFrame, stored: DataFrame | None = None, spread: Spread = Spread()
) -> DataFrame:
    """The accepted attempts."""
    return clock_validate(attempts, stored, spread).filter("accepted").select(*attempts.columns)


def clock_status(events: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Last action, its time and whether the agent is clocked in."""
    last = latest_per_key(events.select(*KEYS, *ORDER, "action"), KEYS, ORDER)
    if agents is not None:
        last = agents.select(*KEYS).distinct().join(last, KEYS, "left")
    return last.select(
        *KEYS,
        F.coalesce(F.col("action") == CLOCK_IN, F.lit(False)).alias("clocked_in"),
        F.col("action").alias("last_action"),
        F.col("event_at").alias("last_at"),
    )


_HISTORY = ["id", "action", "display_name", "event_at", "sheets_synced"]


def clock_history(events: DataFrame, agent: str, limit: int | str | None = None) -> DataFrame:
    """The newest events of one agent."""
    limit = clamp(limit, 1, HISTORY_LIMIT, HISTORY_DEFAULT)
    mine = events.filter(F.col("agent_id") == agent).select(*_HISTORY)
    return page(mine, [F.desc("event_at"), F.desc("id")], limit)


def clock_history_all(events: DataFrame, limit: int = HISTORY_DEFAULT) -> DataFrame:
    """The newest `limit` events of every agent; Spark keeps as many per agent before the shuffle."""
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("event_at"), F.desc("id"))
    ranked = events.select(*KEYS, *_HISTORY).withColumn("position", F.row_number().over(newest))
    return ranked.filter(F.col("position") <= limit)


def latest_per_agent(events: DataFrame) -> DataFrame:
    return latest_per_key(events.select(*KEYS, *ORDER, "display_name", "action"), KEYS, ORDER)


def bulk_clock_out(events: DataFrame, now: Instant, zone: str = DEFAULT_ZONE) -> DataFrame:
    """One clock-out at `now` for every agent whose last event is a clock-in."""
    return (
        latest_per_agent(events)
        .filter(F.col("action") == CLOCK_IN)
        .select(
            *KEYS,
            "display_name",
            F.lit(CLOCK_OUT).alias("action"),
            instant(now).alias("event_at"),
            local_time(instant(now), zone).alias("local_time"),
        )
    )


def _reaching(events: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """The events of the range, and a row per agent for what lies outside.

    The range filter reaches the scan of a stored table. The events before the range are reduced to the agent's last one,
    whose action still holds at its start (an agent without any is out), and those after it to whether the agent is in
    today: `_in`, which only these rows have.
    """
    before = F.when(F.col("event_at") < instant(start), F.struct(*ORDER, "display_name", "action"))
    edges = events.groupBy(*KEYS).agg(F.max(before).alias("_before"), F.max(F.struct(*ORDER, "action")).alias("_last"))
    edges = edges.select(
        *KEYS,
        F.coalesce("_before.event_at", instant(start) - F.expr("interval 1 microsecond")).alias("event_at"),
        F.coalesce("_before.id", F.lit(-1).cast("long")).alias("id"),
        F.col("_before.display_name").alias("display_name"),
        F.coalesce("_before.action", F.lit(CLOCK_OUT)).alias("action"),
        (F.col("_last.action") == CLOCK_IN).alias("_in"),
    )
    inside = _in_range(events, start, end, None).select(*KEYS, *ORDER, "display_name", "action")
    return inside.unionByName(edges, allowMissingColumns=True)


def _paired(events: DataFrame, start: Instant, end: Instant, spread: Spread) -> DataFrame:
    """The events that reach into the range with the action and time of the agent's next one."""
    lead = {"_next_action": "action", "_next_at": "event_at"}
    return slices.with_neighbours(_reaching(events, start, end), KEYS, ORDER, spread, lead=lead)


def _shift(start: Instant, end: Instant) -> tuple[Column, Column]:
    """Whether a paired event opens a shift of the range, and the shift's clock-out."""
    next_at = F.col("_next_at")
    touches = next_at.isNull() | (next_at >= instant(start))
    opens = (F.col("action") == CLOCK_IN) & (F.col("event_at") <= instant(end)) & touches
    closed = (F.col("_next_action") == CLOCK_OUT) & (next_at <= instant(end))
    return opens, F.when(closed, next_at)


def clock_shifts(events: DataFrame, start: Instant, end: Instant, spread: Spread = Spread()) -> DataFrame:
    """Clock-ins up to `end` with their clock-out, where it is the next event."""
    opens, clock_out = _shift(start, end)
    paired = _paired(events, start, end, spread)
    return paired.filter(opens).select(
        *KEYS, "display_name", "id", F.col("event_at").alias("clock_in"), clock_out.alias("clock_out")
    )


def clip_shifts(shifts: DataFrame, start: Instant, end: Instant, now: Instant) -> DataFrame:
    """Cut shifts to the range; an open shift lasts until `now`."""
    return shifts.withColumns(
        {
            "clipped_in": F.greatest("clock_in", instant(start)),
            "clipped_out": F.least(F.coalesce("clock_out", instant(now)), instant(end)),
        }
    )


def clock_summary(
    events: DataFrame,
    start: Instant,
    end: Instant,
    now: Instant,
    max_days: int | None = MAX_RANGE_DAYS,
    spread: Spread = Spread(),
) -> DataFrame:
    """Worked minutes and shifts per agent and display name, most minutes first.

    Only the events of the range are put in order, with one row per agent for the others (see `_reaching`).
    """
    check_range(start, end, max_days)
    opens, clock_out = _shift(start, end)
    marked = _paired(events, start, end, spread).select(
        *KEYS,
        "display_name",
        opens.alias("_opens"),
        F.col("event_at").alias("clock_in"),
        clock_out.alias("clock_out"),
        "_in",
    )
    length = micros_between(F.col("clipped_in"), F.col("clipped_out"))
    named = clip_shifts(marked, start, end, now).groupBy(*KEYS, "display_name").agg(
        whole_minutes(F.sum(F.when(F.col("_opens"), length))).alias("total_minutes"),
        F.count_if("_opens").alias("shifts_count"),
        F.max("_in").alias("_in"),
    )
    # One row per display name of an agent; the state of today is known to one of them.
    current = F.max("_in").over(Window.partitionBy(*KEYS))
    return (
        named.withColumn("currently_clocked", F.coalesce(current, F.lit(False)))
        .filter(F.col("shifts_count") > 0)
        .select(*KEYS, "display_name", "total_minutes", "shifts_count", "currently_clocked")
        .orderBy(F.desc("total_minutes"), "agent_id", "display_name")
    )


def clock_shift_list(
    events: DataFrame,
    start: Instant,
    end: Instant,
    max_days: int | None = MAX_RANGE_DAYS,
    spread: Spread = Spread(),
) -> DataFrame:
    """The shifts behind the summary, one row each, with their unclipped length."""
    check_range(start, end, max_days)
    length = whole_minutes(micros_between(F.col("clock_in"), F.col("clock_out")))
    return clock_shifts(events, start, end, spread).select(
        *KEYS, "display_name", "clock_in", "clock_out", length.alias("duration_minutes")
    )


def clock_events_page(
    events: DataFrame,
    start: Instant,
    end: Instant,
    agent: str | None = None,
    limit: int | str | None = None,
    offset: int = 0,
    max_days: int | None = MAX_RANGE_DAYS,
) -> DataFrame:
    """A page of the closed range, newest first, with the total on every row.

    An empty page has no rows and so no total; `clock_events_count` gives it exactly.
    """
    check_range(start, end, max_days)
    limit = clamp(limit, 1, PAGE_LIMIT, PAGE_DEFAULT)
    found = _in_range(events, start, end, agent)
    rows = found.select("id", *KEYS, "display_name", "action", "event_at", "sheets_synced")
    return with_total(page(rows, [F.desc("event_at"), F.desc("id")], limit, offset), found)


def clock_events_count(
    events: DataFrame, start: Instant, end: Instant, agent: str | None = None
) -> DataFrame:
    return _in_range(events, start, end, agent).agg(F.count("*").alias("total"))


def _in_range(events: DataFrame, start: Instant, end: Instant, agent: str | None) -> DataFrame:
    at: Column = F.col("event_at")
    found = events.filter((at >= instant(start)) & (at <= instant(end)))
    return found.filter(F.col("agent_id") == agent) if agent else found
