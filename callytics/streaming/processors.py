"""Keyed state of the streaming operators: one instance per partition, one key at a time.

Rows of a key are put in event order inside a micro-batch. Times are event times, in
milliseconds unless named otherwise, and state is dropped once the watermark shows that
it can no longer matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callytics.functions.lapsing import staged
from callytics.operators.stages import IDLE
from callytics.sources.schemas import CLOCK_IN, CLOCK_OUT

CHUNK = 10_000


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The key's rows of this micro-batch, which the source's intake limit bounds; ticks are left out."""
    parts = [part[~part["tick"].astype(bool)] if "tick" in part else part for part in rows]
    return pd.concat(parts, ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class KeyedState(StatefulProcessor):
    """A processor with one wake-up per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake_at(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(ms))

    def close(self) -> None:
        pass


class ClockState(KeyedState):
    """Last action of an agent and the time it was accepted (microseconds)."""

    def init(self, handle):
        super().init(handle)
        self.last = handle.getValueState("last", "action string, at bigint")

    def handleInputRows(self, key, rows, timerValues):
        batch = in_order(rows, ["us", "id"])
        action, at = self.last.get() if self.last.exists() else (None, None)
        if batch.empty:
            return
        # An attempt leaves the agent in the state it asks for, so it is judged by the one before it.
        asked, us = batch["action"], batch["us"].astype("Int64")
        previous = asked.shift()
        previous[0] = action or CLOCK_OUT
        accepted = asked != previous
        since = us.where(accepted).shift()
        since[0] = at
        since = since.ffill()
        accepted_at = us.where(accepted).ffill().iloc[-1]
        if not pd.isna(accepted_at):
            action, at = asked.iloc[-1], int(accepted_at)
            self.last.update((action, at))
        refused = asked.map({CLOCK_IN: "already_clocked_in", CLOCK_OUT: "not_clocked_in"})
        yield pd.DataFrame(
            {
                "id": batch["id"],
                "agent_id": batch["agent_id"],
                "display_name": batch["display_name"],
                "action": batch["action"],
                "us": batch["us"],
                "accepted": accepted,
                "error": refused.where(~accepted, None),
                "last_action": previous.where(since.notna(), None),
                "last_us": since,
            }
        )


class StageState(KeyedState):
    """Stage of a call and when it was set; dropped when it has lapsed."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle):
        super().init(handle)
        self.state = handle.getValueState("stage", "rank int, set_at bigint")

    def handleInputRows(self, key, rows, timerValues):
        batch = in_order(rows, ["ts", "seq"])
        if batch.empty:
            return
        stage, set_at = self.state.get() if self.state.exists() else (IDLE, 0)
        # The state so far stands before the turns.
        ts = np.append(batch["ts"].iloc[0], batch["ts"].to_numpy())
        head = np.arange(len(ts)) == 0
        rank = np.append(0, batch["rank"].to_numpy())
        previous, after, at = staged(head, ts, rank, self.ttl_ms, head, np.where(head, stage, 0), np.where(head, set_at, 0))
        self.state.update((int(after[-1]), int(at[-1])))
        self.wake_at(int(at[-1]) + self.ttl_ms)
        turns = batch[["session_id", "seq", "ts", "speaker", "text"]]
        yield turns.assign(previous_rank=previous[1:].astype("int32"), stage_rank=after[1:].astype("int32"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])


class SilenceState(KeyedState):
    """Last frame of a session, or that it was closed; later frames are rejected.

    A closed session is remembered for good: two numbers each.
    """

    def __init__(self, gap_ms: int) -> None:
        self.gap_us = gap_ms * 1000

    def init(self, handle):
        super().init(handle)
        self.state = handle.getValueState("frames", "last_us bigint, closed boolean")

    def _rows(self, key, outcome: str, us) -> pd.DataFrame:
        return pd.DataFrame({"session_id": key[0], "outcome": outcome, "us": us})

    def _close(self, last: int) -> int:
        self.state.update((last, True))
        return last + self.gap_us

    def handleInputRows(self, key, rows, timerValues):
        frames = in_order(rows, ["us"])["us"]
        if frames.empty:
            return
        last, closed = self.state.get() if self.state.exists() else (None, False)
        rejected = frames if closed else frames[:0]
        if not closed:
            if last is not None:  # older frames change nothing
                frames = frames[frames >= last].reset_index(drop=True)
                if frames.empty:
                    return
            before = frames.shift(fill_value=frames.iloc[0] if last is None else last)
            gaps = (frames - before) > self.gap_us
            if gaps.any():
                first = int(gaps.idxmax())
                yield self._rows(key, "closed", [self._close(int(before[first]))])
                rejected = frames[first:]
            else:
                last = max(int(frames.iloc[-1]), last or 0)
                self.state.update((last, False))
                # Silent only after the gap has passed in full.
                self.wake_at((last + self.gap_us) // 1000 + 1)
        if len(rejected):
            yield self._rows(key, "rejected", rejected)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, closed = self.state.get()
        if not closed:
            yield self._rows(key, "closed", [self._close(last)])


class RecentState(KeyedState):
    """The lines of a call still inside the window, at most `max_turns`."""

    def __init__(self, window_ms: int, max_turns: int | None) -> None:
        self.window_ms, self.max_turns = window_ms, max_turns

    def init(self, handle):
        super().init(handle)
        self.lines = handle.getListState("lines", "ts bigint, line string")

    def handleInputRows(self, key, rows, timerValues):
        batch = in_order(rows, ["ts", "seq"])
        if batch.empty:
            return
        kept = [tuple(r) for r in self.lines.get()] if self.lines.exists() else []
        excerpts = []
        for ts, line in zip(batch["ts"].tolist(), batch["line"]):
            kept = [(t, x) for t, x in kept if t >= ts - self.window_ms] + [(ts, line)]
            if self.max_turns is not None:
                kept = kept[-self.max_turns :]
            excerpts.append("\n".join(x for _, x in kept))
        self.lines.put(kept)
        self.wake_at(kept[-1][0] + self.window_ms)
        yield batch[["session_id", "seq", "ts"]].assign(excerpt=excerpts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.lines.clear()
        return iter([])


class TranscriptState(KeyedState):
    """Buffered turns of a call, given out when it ends.

    Outcomes: `stored` at the end, `expired` when nothing was added for `ttl_ms`, `late`
    for turns after the end, which is remembered for good.
    """

    TURN = ["seq", "speaker", "channel", "text", "ts"]

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle):
        super().init(handle)
        self.buffer = handle.getListState(
            "turns", "seq bigint, speaker string, channel smallint, text string, ts bigint"
        )
        self.mark = handle.getValueState("mark", "pushed_at bigint, ended boolean")

    def _given(self, key, turns: list[tuple], outcome: str) -> Iterator[pd.DataFrame]:
        for low in range(0, len(turns), CHUNK):
            part = pd.DataFrame(turns[low : low + CHUNK], columns=self.TURN)
            part.insert(0, "session_id", key[0])
            yield part.assign(channel=part["channel"].astype("int16"), outcome=outcome)

    def _flush(self, key, outcome: str) -> Iterator[pd.DataFrame]:
        turns = [tuple(t) for t in self.buffer.get()] if self.buffer.exists() else []
        self.buffer.clear()
        yield from self._given(key, turns, outcome)

    def handleInputRows(self, key, rows, timerValues):
        batch = in_order(rows, ["ts", "ends", "seq"])
        if batch.empty:
            return
        pushed, ended = self.mark.get() if self.mark.exists() else (None, False)
        fresh: list[tuple] = []
        late: list[tuple] = []
        for ends, *turn in batch[["ends", *self.TURN]].itertuples(index=False, name=None):
            at = int(turn[-1])
            if not ended and pushed is not None and at - pushed >= self.ttl_ms:
                yield from self._flush(key, "expired")
                yield from self._given(key, fresh, "expired")
                fresh, pushed = [], None
            if ends:
                if not ended:
                    yield from self._flush(key, "stored")
                    yield from self._given(key, fresh, "stored")
                    fresh, ended, pushed = [], True, at
            elif ended:
                late.append(tuple(turn))
            else:
                fresh.append((int(turn[0]), turn[1], int(turn[2]), turn[3], at))
                pushed = at
        if fresh:
            self.buffer.appendList(fresh)
        yield from self._given(key, late, "late")
        if pushed is not None:
            self.mark.update((pushed, ended))
            if not ended:
                self.wake_at(pushed + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.mark.get()[1]:
            yield from self._flush(key, "expired")
            self.mark.clear()
