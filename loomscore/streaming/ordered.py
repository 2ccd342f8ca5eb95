"""Keyed state machines in event time: events wait in state until the watermark has passed them, and deadlines fire without an event.

Delivery may be out of order within the watermark's delay: a key's events are held in state and taken in time order once
nothing earlier can come. A machine may set a deadline; if no event comes before it, a timer fires when the watermark
passes it. So the outcome is that of a fold over all events in time order, with expiries in their places, however the events come."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .stream import Step

OUT = "key long, at timestamp, event_id long, decision string"


@dataclass(frozen=True)
class Machine:
    """step(state, now, kind) and expire(state, at) give (state, what is said or None, the deadline or None); times are seconds.

    A state is a JSON value; a null state is forgotten."""

    step: Callable[[Any, float, str], tuple[Any, str | None, float | None]]
    expire: Callable[[Any, float], tuple[Any, str | None, float | None]]
    start: Any


def untimed(machine: tuple[Step, tuple, str]) -> Machine:
    """A machine of `stream` that has no deadlines."""
    step, start, _ = machine

    def on_event(state: Any, now: float, kind: str) -> tuple[Any, str, None]:
        after, said = step(tuple(state), now, kind)
        return list(after), said, None

    return Machine(on_event, lambda state, at: (state, None, None), list(start))


def liveness(seconds: float) -> Machine:
    """A beat keeps a key alive for so many seconds; then it is gone, until the next beat."""
    return Machine(lambda state, now, kind: ("alive", "back" if state == "gone" else None, now + seconds), lambda state, at: ("gone", "gone", None), None)


def leases(seconds: float, most: int, claim: str, beat: str, done: str, failed: str) -> Machine:
    """A key is a task. A claim takes it if it waits, for so many seconds; a beat extends the lease; done and failed end the attempt.

    A lease that runs out, or an attempt that fails, puts the task back in the queue; out of attempts it is dead (failed) or lost (run out). A task
    that has ended takes no more claims."""

    def step(state: list, now: float, kind: str) -> tuple[list, str | None, float | None]:
        status, attempts, due = state
        if kind == claim and status == "waiting":
            return ["running", attempts + 1, now + seconds], "claimed", now + seconds
        if status != "running":
            return state, "refused" if kind == claim else None, None
        if kind == beat:
            return [status, attempts, now + seconds], "extended", now + seconds
        if kind == done:
            return ["succeeded", attempts, None], "succeeded", None
        if kind == failed:
            return [("dead" if attempts >= most else "waiting"), attempts, None], "dead" if attempts >= most else "retrying", None
        return state, "refused" if kind == claim else None, due

    def expire(state: list, at: float) -> tuple[list, str, None]:
        _, attempts, _ = state
        over = attempts >= most
        return [("lost" if over else "waiting"), attempts, None], "lost" if over else "requeued", None

    return Machine(step, expire, ["waiting", 0, None])


def breaker(failures: int, seconds: float, failing: str = "error") -> Machine:
    """Closed until so many failures in a row; open for so many seconds, in which events are refused; then half open by itself, where one event decides."""

    def step(state: list, now: float, kind: str) -> tuple[list, str | None, float | None]:
        status, count, due = state
        if status == "open":
            return state, "refused", due
        if kind != failing:
            return ["closed", 0, None], "closed" if status == "half_open" else None, None
        if status == "half_open" or count + 1 >= failures:
            return ["open", count + 1, now + seconds], "tripped", now + seconds
        return ["closed", count + 1, None], None, None

    def expire(state: list, at: float) -> tuple[list, str, None]:
        return ["half_open", state[1], None], "half_open", None

    return Machine(step, expire, ["closed", 0, None])


def advance(machine: Machine, state: Any, due: float | None, events: Iterable[tuple[float, int, str]], upto: float) -> tuple[Any, float | None, list[tuple[float, int | None, str]]]:
    """The state, the deadline and what is said (at, event, decision) after events in time order, up to a time past which no deadline fires.

    A deadline at the very time of an event comes after it."""
    said = []
    for now, event, kind in events:
        while due is not None and due < now:
            at = due
            state, word, due = machine.expire(state, at)
            if word is not None:
                said.append((at, None, word))
        state, word, due = machine.step(state, now, kind)
        if word is not None:
            said.append((now, event, word))
    while due is not None and due < upto:
        at = due
        state, word, due = machine.expire(state, at)
        if word is not None:
            said.append((at, None, word))
    return state, due, said


def _frame(said: list[tuple[int, float, int | None, str]]) -> pd.DataFrame:
    key, at, event, decision = zip(*said, strict=True)
    at = pd.to_datetime([round(x * 1e6) for x in at], unit="us", utc=True)
    return pd.DataFrame({"key": pd.Series(key, dtype="int64"), "at": at, "event_id": pd.array(event, "Int64"), "decision": pd.Series(decision, dtype="object")})


def decide_in_order(
    events: DataFrame, machine: Machine, delay: str, key: str = "user_id", ts: str = "ts", kind: str = "event_type", seq: str = "event_id", groups: int = 1024
) -> DataFrame:
    """(key, at, event_id, decision) of a stream under a machine, in event time; an expiry has no event_id.

    Events may come out of order by `delay`; later ones are `late` or dropped by Spark, and change nothing. What has been decided is
    settled: a restart from the stream's checkpoint repeats and loses nothing. A key's state is its machine's and the events of the last
    `delay`. Keys are dealt over `groups`, which a checkpoint fixes: calls of Python cost more than events, so a batch calls
    each group once at most, with its events or as its timer (for the first of what waits and of deadlines) has run out."""
    rows = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(key).alias("key"), F.col(seq).alias("event_id"), F.col(kind).alias("kind"))
    rows = rows.withColumn("at", F.unix_micros("ts") / 1e6).withColumn("dealt", F.pmod(F.xxhash64("key"), F.lit(groups))).withWatermark("ts", delay)

    def run(_: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed, said, fresh = state.getCurrentWatermarkMs(), [], {}
        if not state.hasTimedOut:
            for frame in frames:
                for own, *event in zip(*(frame[c].tolist() for c in ("key", "at", "event_id", "kind")), strict=True):
                    if event[0] * 1000 < passed:
                        said.append((own, event[0], event[1], "late"))
                    else:
                        fresh.setdefault(own, []).append(event)
        kept = {own: rest for own, *rest in json.loads(state.get[0])} if state.exists else {}
        after, first = [], []
        for own in kept.keys() | fresh.keys():
            status, due, held = kept.get(own, (machine.start, None, []))
            held = sorted(held + fresh.get(own, []))
            n = bisect_left(held, passed, key=lambda e: e[0] * 1000)
            if n or (due is not None and due * 1000 < passed):
                status, due, words = advance(machine, status, due, held[:n], passed / 1000)
                said += [(own, *word) for word in words]
            rest = held[n:]
            if status is not None or due is not None or rest:
                after.append((own, status, due, rest))
            first += [e[0] for e in rest[:1]] + ([due] if due is not None else [])
        if after:
            state.update((json.dumps(after),))
            if first:
                state.setTimeoutTimestamp(max(int(min(first) * 1000), passed) + 1)
        elif state.exists:
            state.remove()
        if said:
            yield _frame(said)

    return rows.groupBy("dealt").applyInPandasWithState(run, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def replay(machine: Machine, events: Iterable[tuple[float, int, str]], upto: float) -> list[tuple[float, int | None, str]]:
    """What is said of one key's events, in time order, by a plain fold (for checking)."""
    return advance(machine, machine.start, None, events, upto)[2]
