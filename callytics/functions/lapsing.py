"""Stages that lapse, for many turns at once.

A turn that changes the stage of a call sets it to a value of its own (`reached`), whatever the stage was, at the time
of the turn. So from each turn, taken as such a change, leads one pointer to the next change: the first later turn that
moves this stage, or that comes when it has lapsed. The turns that do change the stage are those met on the way along
these pointers from the first turn of the session; pointers are doubled until none leads further.

A run of turns thus maps the state before it (stage, time set) to the state after it, and such maps compose: `Run` is
that map, summed up so that only the turns where its result differs are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rank of the stage that is reached from anywhere, and of the last stage a turn can reach.
OBJECTION, LAST = 4, 6


def reached(rank: np.ndarray) -> np.ndarray:
    """The stage a changing turn leads to; rank 0 stands for a turn that points to none."""
    return np.maximum(rank, 1)


def moves(rank: np.ndarray, stage: int) -> np.ndarray:
    """Turns that change this stage while it lasts."""
    if stage == 0:
        return np.ones(len(rank), bool)
    return np.where(rank == OBJECTION, stage != OBJECTION, rank > stage)


def next_changes(
    first: np.ndarray, ts: np.ndarray, rank: np.ndarray, stage: np.ndarray, set_at: np.ndarray, turn: np.ndarray, ttl: int
) -> np.ndarray:
    """Of each row, as a change to `stage` at `set_at`, the number of the next change of its session, or the row count.

    `first` marks where sessions begin, and `ts` rises inside a session. Rows that are no `turn` change nothing.
    """
    n = len(ts)
    number = np.arange(n)
    begin = np.flatnonzero(first)
    session = np.cumsum(first) - 1
    found = np.full(n, n)
    for value in range(LAST + 1):
        mine = np.flatnonzero(stage == value)
        if len(mine):
            ahead = np.minimum.accumulate(np.where(turn & moves(rank, value), number, n)[::-1])[::-1]
            found[mine] = np.append(ahead, n)[mine + 1]
    since = ts - ts[begin][session]
    width = int(since.max(initial=0)) + 2
    if len(begin) * width >= 1 << 62:
        raise ValueError("the sessions of one batch span too long a time")
    lapses = np.clip(set_at + ttl - ts[begin][session], 0, width - 1)
    lapsed = np.searchsorted(session * width + since, session * width + lapses, "left")
    found = np.minimum(found, np.maximum(lapsed, number + 1))
    return np.where(found < np.append(begin[1:], n)[session], found, n)


def staged(
    first: np.ndarray, ts: np.ndarray, rank: np.ndarray, ttl: int, carried: np.ndarray, stage: np.ndarray, set_at: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stage before and after each row, and when the latter was set.

    Rows stand session by session, in order. A `carried` row is no turn; it stands first and gives the state the session is
    in, (`stage`, `set_at`), with a `ts` not above that of the next row.
    """
    n = len(ts)
    value = np.where(carried, stage, reached(rank))
    since = np.where(carried, set_at, ts)
    pointer = np.append(next_changes(first, ts, rank, value, since, ~carried, ttl), n)
    changes = np.append(first, False)
    while True:
        more = changes.copy()
        more[pointer[np.flatnonzero(changes)]] = True
        more[n] = False
        pointer = pointer[pointer]
        if (pointer == n).all() and (more == changes).all():
            break
        changes = more
    last = np.maximum.accumulate(np.where(changes[:n], np.arange(n), 0))
    after, at = value[last], since[last]
    previous = np.zeros(n, np.int64)
    previous[1:] = np.where(first[1:] | (ts[1:] - at[:-1] >= ttl), 0, after[:-1])
    return previous, after, at


@dataclass
class Run:
    """A run of turns of one session as a map of states.

    `moved[s]` is the time of the first turn that changes stage s (None if none does) and the state after the run then.
    Turns at which the stage may lapse are grouped while they lead to one state: `until` are the last times of the groups.
    """

    moved: list[tuple[int, int, int] | None]
    until: np.ndarray
    stage: np.ndarray
    set_at: np.ndarray

    @staticmethod
    def of(ts: np.ndarray, rank: np.ndarray, ttl: int) -> Run:
        n = len(ts)
        first = np.zeros(n, bool)
        first[0] = True
        value = reached(rank)
        pointer = next_changes(first, ts, rank, value, ts, np.ones(n, bool), ttl)
        pointer = np.where(pointer < n, pointer, np.arange(n))
        while not (pointer == (further := pointer[pointer])).all():
            pointer = further
        end = np.flatnonzero(np.append(pointer[1:] != pointer[:-1], True))
        moved = []
        for s in range(LAST + 1):
            at = moves(rank, s)
            k = int(at.argmax())
            moved.append((int(ts[k]), int(value[pointer[k]]), int(ts[pointer[k]])) if at[k] else None)
        return Run(moved, ts[end], value[pointer[end]], ts[pointer[end]])

    def __call__(self, stage: int, set_at: int, ttl: int) -> tuple[int, int]:
        """The state after the run, from the state before it."""
        moved = self.moved[stage]
        if stage == 0 or (moved and moved[0] - set_at < ttl):
            return moved[1:]
        group = int(np.searchsorted(self.until, set_at + ttl, "left"))
        if group < len(self.until):
            return int(self.stage[group]), int(self.set_at[group])
        return moved[1:] if moved else (stage, set_at)
