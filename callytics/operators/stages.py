"""Keyword matches, call stages and signals."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from callytics.functions.lapsing import Run, staged
from callytics.functions.text import any_of, longest_words, those_of, with_nested
from callytics.plans import slices
from callytics.plans.intervals import as_of
from callytics.plans.keyed import latest_per_key
from callytics.plans.slices import Spread
from callytics.sources.schemas import ACTIVE, AGENT, CLIENT, KEYWORD_GROUPS, STAGES

Groups = Mapping[str, Sequence[str]]

KEYS = ["session_id"]
ORDER = ["ts", "seq"]
RANK = {stage: rank for rank, stage in enumerate(STAGES)}
IDLE, OPENING, OBJECTION = RANK["idle"], RANK["opening"], RANK["objection_handling"]

# Which keyword group leads to which stage, in order of precedence.
STAGE_OF_GROUP = (
    ("followUp", "follow_up"),
    ("closing", "closing"),
    ("objections", "objection_handling"),
    ("product", "presentation"),
    ("discovery", "discovery"),
)

# Signals as (type, group, client turns only, confidence, reason prefix), in order.
SIGNALS = (
    ("objection_detected", "objections", True, 0.82, "Objeción detectada: "),
    ("risk_detected", "risk", False, 0.78, "Riesgo de compliance detectado: "),
    ("closing_opportunity", "closing", True, 0.74, "Oportunidad de cierre detectada: "),
)
MANUAL = ("manual_request", 1.0, "El agente pidió manualmente una recomendación.")

# Fixed value: a stage lapses this long after it was last changed.
STAGE_TTL_SECONDS = 3_600


def stage_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STAGES]), rank)


def groups_from(vocabulary: DataFrame) -> dict[str, list[str]]:
    """Keyword groups from a (group, position, keyword) table, which becomes part of the plan."""
    rows = vocabulary.orderBy("group", "position").collect()
    groups: dict[str, list[str]] = {}
    for row in rows:
        groups.setdefault(row["group"], []).append(row["keyword"])
    return groups


def _scanned(turns: DataFrame, groups: Groups, names: Sequence[str]) -> DataFrame:
    """Turns with the keywords of these groups that occur in them, by one scan of the text."""
    words = [w for name in names for w in groups.get(name, ())]
    # In two steps, so that the scan stands in the plan once.
    longest = turns.withColumn("_longest", longest_words(F.lower("text"), words))
    return longest.withColumn("_found", with_nested(F.col("_longest"), words)).drop("_longest")


def keyword_matches(turns: DataFrame, groups: Groups = KEYWORD_GROUPS) -> DataFrame:
    """One array column per group with the keywords found in the turn, in list order."""
    found = {f"{name}_matches": those_of(F.col("_found"), words) for name, words in groups.items()}
    return _scanned(turns, groups, list(groups)).withColumns(found).drop("_found")


def _detected(groups: Groups) -> Column:
    """Rank of the stage a turn points to by its keywords, null when it points to none."""
    chain = None
    for group, stage in STAGE_OF_GROUP:
        hit = any_of(F.col("_found"), groups.get(group, ()))
        rank = F.lit(RANK[stage])
        chain = F.when(hit, rank) if chain is None else chain.when(hit, rank)
    return chain


def _ranked(turns: DataFrame, groups: Groups) -> DataFrame:
    return _scanned(turns, groups, [g for g, _ in STAGE_OF_GROUP]).withColumn("_rank", _detected(groups)).drop("_found")


def turn_stage_detect(turns: DataFrame, groups: Groups = KEYWORD_GROUPS) -> DataFrame:
    """The stage each turn points to by itself, null for none."""
    detected = _ranked(turns, groups)
    return detected.withColumn("detected_stage", stage_name(F.col("_rank"))).drop("_rank")


def stage_progression(
    turns: DataFrame,
    groups: Groups = KEYWORD_GROUPS,
    initial: str = "opening",
    spread: Spread = Spread(),
) -> DataFrame:
    """Turns with previous_stage, stage and changed.

    A call moves forward or stays, and an objection pulls it to objection_handling from
    anywhere. The stage is thus the highest rank since the last objection. A slice is
    summed up by the number of objections in it and the highest rank after the last one.
    """
    if initial not in ("idle", "opening"):
        raise ValueError("a session starts idle or opening")
    rows = slices.sliced(_ranked(turns, groups), KEYS, ORDER, spread)
    window = slices.inside(rows, KEYS, ORDER)
    objections = F.sum(F.when(F.col("_rank") == OBJECTION, 1).otherwise(0))
    floor = F.lit(OPENING)

    hot, carry = slices.hot_only(rows), None
    if hot is not None:
        edges = (
            hot.withColumn("_segment", objections.over(slices.upto(window)))
            .groupBy(*KEYS, slices.SLICE)
            .agg(F.max(F.struct("_segment", "_rank")).alias("_tail"), F.max(F.struct(*ORDER)).alias("_last"))
        )
        order = slices.across(KEYS)
        resets = F.sum(F.when(F.col("_tail._segment") > 0, 1).otherwise(0))
        segment = Window.partitionBy(*KEYS, "_reset").orderBy(slices.SLICE)
        carry = (
            edges.withColumn("_reset", resets.over(slices.upto(order)))
            .withColumn("_state", F.greatest(floor, F.max("_tail._rank").over(slices.upto(segment))))
            .withColumns({"_rank": F.lag("_state").over(order), "_before": F.lag("_last").over(order)})
            .filter(F.col("_before").isNotNull())
            .select(*KEYS, slices.SLICE, "_before.ts", "_before.seq", "_rank")
        )

    segment = Window.partitionBy(*slices.place(rows, KEYS), "_segment").orderBy(*ORDER)
    staged = (
        slices.with_carry(rows, carry)
        .withColumn("_segment", objections.over(slices.upto(window)))
        .withColumn("_state", F.greatest(floor, F.max("_rank").over(slices.upto(segment))))
        .withColumn("_previous", F.coalesce(F.lag("_state").over(window), F.lit(RANK[initial])))
    )
    return slices.without_carry(staged).select(
        *turns.columns,
        stage_name(F.col("_previous")).alias("previous_stage"),
        stage_name(F.col("_state")).alias("stage"),
        (F.col("_state") != F.col("_previous")).alias("changed"),
    )


def stage_changes(progress: DataFrame) -> DataFrame:
    return progress.filter("changed").select("session_id", "seq", "ts", "previous_stage", "stage")


def current_stage(progress: DataFrame, sessions: DataFrame) -> DataFrame:
    """The last stage of every session, idle when it has none or, where `status` is given, ended."""
    last = latest_per_key(progress.select(*KEYS, *ORDER, "stage"), KEYS, ORDER)
    opened = F.col("status") == ACTIVE if "status" in sessions.columns else F.lit(True)
    return (
        sessions.select(F.col("id").alias("session_id"), opened.alias("_open"))
        .join(last, "session_id", "left")
        .select("session_id", F.coalesce(F.when(F.col("_open"), F.col("stage")), F.lit("idle")).alias("stage"))
    )


def _folded(rows: DataFrame, ttl_ms: int) -> DataFrame:
    """Stages of rows (slice, session, ts, seq, _rank) and of carry rows (_stage, _set_at), many rows at a time."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, (IDLE, 0)
        for batch in batches:
            if batch.empty:
                continue
            session, place = batch["session_id"].to_numpy(), batch[slices.SLICE].to_numpy()
            first = np.append(True, (session[1:] != session[:-1]) | (place[1:] != place[:-1]))
            columns = [batch[c].to_numpy() for c in ("ts", "_rank", slices.CARRY, "_stage", "_set_at")]
            # The state of the last session of the batch before stands in front as a carry row.
            goes_on = key == (place[0], session[0])
            if goes_on:
                columns = [np.append(v, c) for v, c in zip((columns[0][0], 0, True, *state), columns)]
                first = np.append(True, np.append(False, first[1:]))
            ts, rank, carried, stage, set_at = columns
            previous, after, at = staged(first, ts, rank, ttl_ms, carried.astype(bool), stage, set_at)
            key, state = (place[-1], session[-1]), (int(after[-1]), int(at[-1]))
            told = batch[["session_id", "ts", "seq", slices.CARRY]]
            yield told.assign(_previous=previous[goes_on:].astype("int32"), _state=after[goes_on:].astype("int32"))

    place = [slices.SLICE, *KEYS]
    dealt = rows.repartition(*place).sortWithinPartitions(*place, F.desc(slices.CARRY), *ORDER)
    id_type = rows.schema["session_id"].dataType.simpleString()
    schema = f"session_id {id_type}, ts bigint, seq bigint, {slices.CARRY} boolean, _previous int, _state int"
    return dealt.select(*place, *ORDER, "_rank", slices.CARRY, "_stage", "_set_at").mapInPandas(fold, schema)


def _entered(placed: DataFrame, ttl_ms: int) -> DataFrame:
    """Carry rows: the state in which each slice of a hot session begins, but for its first one.

    Each slice is summed up as a map from the state before it to the state after it (see `Run`), by itself. The maps of a
    session, one row per slice, are then applied one after the other.
    """

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []  # parts of one slice of one session, which `slice_rows` bounds

        def out() -> tuple:
            ts, rank = (np.concatenate(v) for v in zip(*held))
            run = Run.of(ts, rank, ttl_ms)
            moved = [list(m) if m else None for m in run.moved]
            return *key, int(ts[0]), moved, run.until.tolist(), run.stage.tolist(), run.set_at.tolist()

        names = ["session_id", slices.SLICE, "ts", "moved", "until", "stages", "set_ats"]
        for batch in batches:
            session, place, ts, rank = (batch[c].to_numpy() for c in ("session_id", slices.SLICE, "ts", "_rank"))
            cuts = np.flatnonzero((session[1:] != session[:-1]) | (place[1:] != place[:-1])) + 1
            runs = []
            for low, high in zip([0, *cuts], [*cuts, len(batch)]) if len(batch) else ():
                if held and key != (session[low], place[low]):
                    runs.append(out())
                    held.clear()
                key = session[low], place[low]
                held.append((ts[low:high], rank[low:high]))
            if runs:
                yield pd.DataFrame(runs, columns=names)
        if held:
            yield pd.DataFrame([out()], columns=names)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, (IDLE, 0)
        names = ["session_id", slices.SLICE, "ts", "moved", "until", "stages", "set_ats"]
        for runs in batches:
            told = []
            for session, number, ts, moved, *groups in zip(*(runs[c] for c in names)):
                if session == key:
                    told.append((session, number, ts, *state))
                else:
                    key, state = session, (IDLE, 0)
                run = Run([tuple(m) if m is not None else None for m in moved], *map(np.array, groups))
                state = run(*state, ttl_ms)
            if told:
                yield pd.DataFrame(told, columns=["session_id", slices.SLICE, "ts", "_stage", "_set_at"])

    place = [slices.SLICE, *KEYS]
    id_type = placed.schema["session_id"].dataType.simpleString()
    head = f"session_id {id_type}, {slices.SLICE} bigint, ts bigint"
    dealt = placed.repartition(*place).sortWithinPartitions(*place, *ORDER).select(*place, *ORDER, "_rank")
    runs = dealt.mapInPandas(summed, f"{head}, moved array<array<bigint>>, until array<bigint>, stages array<bigint>, set_ats array<bigint>")
    told = runs.repartition(*KEYS).sortWithinPartitions(*KEYS, slices.SLICE)
    return told.mapInPandas(joined, f"{head}, _stage bigint, _set_at bigint")


def stage_progression_ttl(
    turns: DataFrame,
    sessions: DataFrame,
    groups: Groups = KEYWORD_GROUPS,
    ttl_seconds: int = STAGE_TTL_SECONDS,
    spread: Spread = Spread(),
    with_starts: bool = False,
) -> DataFrame:
    """Stages that lapse `ttl_seconds` after their last change; `with_starts` gives session starts as rows of seq -1 too.

    A session start sets the opening stage, as a turn without keywords would. Sessions are staged batch by batch, many
    rows at once; hot ones in slices by position, each of which begins with the state the slices before it lead to.
    """
    ttl_ms = ttl_seconds * 1000
    begun = sessions.select(
        F.col("id").alias("session_id"),
        F.unix_millis("started_at").alias("ts"),
        F.lit(-1).cast("long").alias("seq"),
    )
    slim = _ranked(turns, groups).select(*KEYS, *ORDER, "_rank")
    rows = slim.unionByName(begun, allowMissingColumns=True).withColumn("_rank", F.coalesce("_rank", F.lit(0)))
    normal, placed = slices.parted(rows, KEYS, ORDER, slices.with_hot(spread, turns, KEYS))
    no_state = {slices.CARRY: F.lit(False), "_stage": F.lit(0).cast("long"), "_set_at": F.lit(0).cast("long")}
    all_rows = normal.withColumn(slices.SLICE, F.lit(-1).cast("long")).withColumns(no_state)
    if placed is not None:
        carry = _entered(placed, ttl_ms).withColumns({"seq": F.lit(-1).cast("long"), "_rank": F.lit(0), slices.CARRY: F.lit(True)})
        all_rows = all_rows.unionByName(placed.withColumns(no_state)).unionByName(carry)
    folded = _folded(all_rows, ttl_ms)
    turns_only = F.lit(True) if with_starts else F.col("seq") >= 0
    return folded.filter(~F.col(slices.CARRY) & turns_only).select(
        "session_id",
        "ts",
        "seq",
        stage_name(F.col("_previous")).alias("previous_stage"),
        stage_name(F.col("_state")).alias("stage"),
        (F.col("_state") != F.col("_previous")).alias("changed"),
    )


def stage_intervals(changes: DataFrame, ttl_seconds: int = STAGE_TTL_SECONDS, spread: Spread = Spread()) -> DataFrame:
    """(session_id, stage, start, end), in milliseconds: each stage from its change to the next one or until it lapses.

    `changes` are the changed rows of `stage_progression_ttl`, session starts among them.
    """
    rows = slices.with_neighbours(changes.select(*KEYS, *ORDER, "stage"), KEYS, ORDER, spread, lead={"_next": "ts"})
    end = F.least(F.col("ts") + ttl_seconds * 1000, "_next")
    return rows.select(*KEYS, "stage", F.col("ts").alias("start"), end.alias("end")).filter(F.col("start") < F.col("end"))


def signals(progress: DataFrame, groups: Groups = KEYWORD_GROUPS) -> DataFrame:
    """At most one signal per turn, with the keywords that caused it and the stage after it."""
    kind = None
    for number, (_, group, client_only, _, _) in enumerate(SIGNALS):
        hit = any_of(F.col("_found"), groups.get(group, ()))
        if client_only:
            hit = (F.col("speaker") == CLIENT) & hit
        kind = F.when(hit, F.lit(number)) if kind is None else kind.when(hit, F.lit(number))

    def by_kind(values: Sequence[Column]) -> Column:
        chain = F.when(F.col("_kind") == 0, values[0])
        for number, value in enumerate(values[1:], start=1):
            chain = chain.when(F.col("_kind") == number, value)
        return chain

    words = [those_of(F.col("_found"), groups.get(s[1], ())) for s in SIGNALS]
    return (
        _scanned(progress, groups, [s[1] for s in SIGNALS])
        .withColumn("_kind", kind)
        .filter(F.col("_kind").isNotNull())
        .withColumn("matched_keywords", by_kind(words))
        .select(
            "session_id",
            "seq",
            "ts",
            "speaker",
            by_kind([F.lit(s[0]) for s in SIGNALS]).alias("signal_type"),
            by_kind([F.lit(s[3]) for s in SIGNALS]).alias("confidence"),
            F.concat(by_kind([F.lit(s[4]) for s in SIGNALS]), F.array_join("matched_keywords", ", ")).alias(
                "reason"
            ),
            "matched_keywords",
            "stage",
        )
    )


def judged_requests(requests: DataFrame, sessions: DataFrame, at: Column) -> DataFrame:
    """`requests` (session_id, agent_id ...) with `reason`: only the owner may ask, while the session is open."""
    known = sessions.select(F.col("id").alias("session_id"), F.col("agent_id").alias("_owner"), "started_at", "ended_at")
    opened = F.coalesce((at >= F.col("started_at")) & F.coalesce(at < F.col("ended_at"), F.lit(True)), F.lit(False))
    owned = F.coalesce(F.col("_owner") == F.col("agent_id"), F.lit(False))
    reason = F.when(~opened, "session_not_found").when(~owned, "forbidden")
    return requests.join(known, "session_id", "left").select(*requests.columns, reason.alias("reason"))


def manual_signals(requests: DataFrame, intervals: DataFrame, ttl_seconds: int = STAGE_TTL_SECONDS, spread: Spread = Spread()) -> DataFrame:
    """Signals an agent asked for (request_id, session_id, at in ms), at the stage the session is in just then.

    `intervals` are those of `stage_intervals`; a session without a stage at that time is idle.
    """
    kind, confidence, reason = MANUAL
    asked = as_of(requests.select("request_id", *KEYS, "at"), intervals, KEYS, "at", ttl_seconds * 1000, spread)
    return asked.select(
        "request_id",
        "session_id",
        F.lit(None).cast("long").alias("seq"),
        F.col("at").alias("ts"),
        F.lit(AGENT).alias("speaker"),
        F.lit(kind).alias("signal_type"),
        F.lit(confidence).alias("confidence"),
        F.lit(reason).alias("reason"),
        F.array().cast("array<string>").alias("matched_keywords"),
        F.coalesce("stage", F.lit("idle")).alias("stage"),
    )
