"""A supervisor of the ingest: retries with exponential backoff, and events."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from strandlog.streaming.seal import Repository, Sealed

#: Seconds before the first retry, the longest wait, and failures in a row that end it.
FIRST, CAP, MOST = 1.0, 300.0, 10


@dataclass(frozen=True)
class Event:
    """kind: BundleCreated, CaughtUp, InitialSyncComplete or Error."""

    kind: str
    bundle: int | None = None
    detail: str = ""


def waits(first: float = FIRST, cap: float = CAP, most: int = MOST):
    """Seconds to wait after the 1st, 2nd, ... failure in a row; it ends where one has to give up."""
    for k in range(most - 1):
        yield min(cap, first * 2**k)


def events_of(state: Sealed, synced: bool) -> list[Event]:
    """The events of one batch; synced says that an earlier one had caught up already."""
    out = [Event("BundleCreated", b) for b in state.bundles]
    if state.caught_up:
        out += [] if synced else [Event("InitialSyncComplete", state.last_bundle)]
        out.append(Event("CaughtUp", state.last_bundle, f"{state.pending} pending"))
    return out


def supervise(
    once: Callable[[], None], repository: Repository, on_event: Callable[[Event], None] = lambda e: None, rounds: int | None = None,
    interval: float = 60.0, initial: float = 0.5, first: float = FIRST, cap: float = CAP, most: int = MOST, sleep: Callable[[float], None] = time.sleep,
) -> int:
    """Calls once() (one run of the ingest, such as a stream with availableNow) again and again; returns the number of good runs.

    Until the ingest has caught up for the first time it goes on after `initial` seconds, then
    every `interval`. A failure is an Error event, and once() is tried again after waits that
    double from `first` up to `cap`; the `most`-th in a row is raised. rounds ends it after so
    many good runs.
    """
    state = repository.last()
    seen, synced, good = (state.batch, state.part) if state else (-1, 0), False, 0
    pause = waits(first, cap, most)
    while rounds is None or good < rounds:
        try:
            once()
        except Exception as e:
            on_event(Event("Error", detail=str(e)[:500]))
            wait = next(pause, None)
            if wait is None:
                raise
            sleep(wait)
            continue
        pause = waits(first, cap, most)
        good += 1
        state = repository.last()
        if state and (state.batch, state.part) > seen:
            new = f"batch > {seen[0]} or batch = {seen[0]} and part > {seen[1]}"
            for row in repository.fetch_log().where(new).orderBy("batch", "part").toLocalIterator():
                done = Sealed(**row.asDict())
                for e in events_of(done, synced):
                    on_event(e)
                synced = synced or done.caught_up
            seen = state.batch, state.part
        if rounds is None or good < rounds:
            sleep(interval if synced else initial)
    return good
