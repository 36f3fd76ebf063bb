"""Time-driven state by key, as folds: the same fold runs over a stream (state with an end in event time) or over a table (a replay).

A fold takes the key's state (a JSON value, None at first) and an event (a dict with ts in seconds) and returns the new state and the columns of its result.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fold = Callable[[object, dict], tuple[object, tuple]]


def limiter(limits: list[tuple[int, float]]) -> tuple[Fold, str]:
    """Several sliding windows (limit, seconds) together, the tightest decides. Only allowed hits occupy a window; kind `refund` takes back the hit with
    the event's member. Times are kept sorted, and those that the widest window has left are cut off."""
    widest = max(w for _, w in limits)

    def fold(state, e):
        times, members = state or ([], [])
        if e["kind"] == "refund":
            keep = [i for i, m in enumerate(members) if m != e["member"]]
            state = [times[i] for i in keep], [members[i] for i in keep]
            return state, (len(keep) < len(members), None, None)
        gone = bisect_right(times, e["ts"] - widest)
        times, members = times[gone:], members[gone:]
        free = [limit - (len(times) - bisect_right(times, e["ts"] - window)) for limit, window in limits]
        allowed = min(free) > 0
        if allowed:
            at = bisect_right(times, e["ts"])
            times, members = [*times[:at], e["ts"], *times[at:]], [*members[:at], e["member"], *members[at:]]
        tight = min(range(len(limits)), key=lambda i: free[i])
        first = times[bisect_right(times, e["ts"] - limits[tight][1])] if times else e["ts"]
        return (times, members), (allowed, max(0, min(free) - allowed), float(first + limits[tight][1]))

    return fold, "allowed boolean, remaining int, reset double"


def gauge(ttl: float) -> tuple[Fold, str]:
    """A count whose increments end after `ttl` seconds; kind `down` ends the oldest one."""

    def fold(state, e):
        ends = [x for x in state or [] if x > e["ts"]]
        ends = ends[1:] if e["kind"] == "down" else [*ends, e["ts"] + ttl]
        return ends, (len(ends),)

    return fold, "level int"


def machine(legal: dict[str, list[str]], first: str) -> tuple[Fold, str]:
    """A job's state: the event's kind is the state asked for; moves that aren't legal leave it as it is."""

    def fold(state, e):
        now = state or first
        good = e["kind"] in legal.get(now, [])
        return (e["kind"] if good else now), (now, good)

    return fold, "before string, legal boolean"


def event_log(cap: int) -> tuple[Fold, str]:
    """Numbers a key's events; the state holds the last `cap`, and tells a reader who knows events up to `member` how many are to come and whether some are lost."""

    def fold(state, e):
        last, held = state or (0, 0)
        if e["kind"] == "resume":
            seen = int(e["member"])
            return state or (0, 0), (None, min(held, last - seen), last - held > seen)
        return (last + 1, min(cap, held + 1)), (last + 1, None, None)

    return fold, "seq int, pending int, lost boolean"


def bucket(rate: float, burst: float, up: float, down: float, least: float) -> tuple[Fold, str]:
    """A token bucket whose rate rises by `up` with each success and is multiplied by `down` when the server pushes back (kind `busy`)."""

    def fold(state, e):
        level, now, at = state or (burst, rate, e["ts"])
        level = min(burst, level + (e["ts"] - at) * now)
        if e["kind"] == "busy":
            return (level, max(least, now * down), e["ts"]), (None, round(max(least, now * down), 6))
        taken = level >= 1
        now = now + up if taken else now
        return (level - taken, now, e["ts"]), (taken, round(now, 6))

    return fold, "taken boolean, rate double"


def _columns(result: str) -> list[str]:
    return ["key", "event_id", *(x.split()[0] for x in result.split(", "))]


def _schema(result: str) -> str:
    return f"key string, event_id long, {result}"


def _run(fold: Fold, state, rows: pd.DataFrame, out: list):
    for e in rows.sort_values(["ts", "event_id"]).to_dict("records"):
        state, found = fold(state, {**e, "ts": e["ts"].timestamp()})
        out.append((e["key"], e["event_id"], *found))
    return state


def replay(events: DataFrame, fold: Fold, result: str) -> DataFrame:
    """events: (key, event_id, ts timestamp, kind, member). (key, event_id, result) of a whole table, each key's events in order. A key is a sequence, so it is one task."""
    names = _columns(result)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        _run(fold, None, rows, out)
        return pd.DataFrame(out, columns=names).astype(object)

    return events.groupBy("key").applyInPandas(run, _schema(result))


def stream(events: DataFrame, fold: Fold, result: str, keep_s: int, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: rows later than the watermark are left out, and a key's state ends once the watermark is keep_s seconds past its last event.
    Events of one micro-batch are taken in order of time; one that comes a batch later, within the watermark, is taken then."""
    names = _columns(result)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        out: list = []
        held = _run(fold, json.loads(state.get[0]) if state.exists else None, rows, out)
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_s * 1000 + 1)
        yield pd.DataFrame(out, columns=names).astype(object)

    # A watermark begins at 1970 and takes what is not above it for late, so its column runs a second ahead.
    timed = events.withColumn("__at", F.col("ts") + F.expr("INTERVAL 1 SECOND")).withWatermark("__at", late)
    return timed.groupBy("key").applyInPandasWithState(run, _schema(result), "held string", "append", "EventTimeTimeout")
