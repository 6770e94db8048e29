"""The debounce as a Structured Streaming operator: state per page, due times by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "batch long, events long, first_ms long, due_ms long, newest_ms long, newest_event long"
OUT = "page long, batch long, events long, first_ms long, due_ms long, newest_event long"


def debounce_stream(hints: DataFrame, quiet_ms: int, cap_ms: int, late: str = "10 minutes") -> DataFrame:
    """Batches of a stream of hints (page long, event_id long, ts timestamp), each sent once its due time has passed."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        batch, events, first, due, newest_ms, newest = state.get if state.exists else (0, 0, 0, 0, 0, 0)
        if state.hasTimedOut:
            if events:
                out.append((key[0], batch, events, first, due, newest))
            state.update((batch + 1, 0, 0, 0, 0, 0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
            return
        rows = sorted((int(t.timestamp() * 1000), int(e)) for part in parts for t, e in zip(part["ts"], part["event_id"], strict=True))
        for ms, event in rows:
            if events and ms >= due:
                out.append((key[0], batch, events, first, due, newest))
                batch, events = batch + 1, 0
            if not events:
                events, first, due, newest_ms, newest = 1, ms, ms + min(quiet_ms, cap_ms), ms, event
                continue
            if ms > newest_ms:
                due = max(due, min(ms + quiet_ms, first + cap_ms))
            newest_ms, newest = max((newest_ms, newest), (ms, event))
            events += 1
        state.update((batch, events, first, due, newest_ms, newest))
        if events:
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    known = hints.filter("page IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(["page", "event_id"])
    return known.groupBy("page").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
