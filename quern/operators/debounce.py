"""Trailing-edge debounce with a cap, in batch and as a stream.

Per page: the first hint opens a batch that is due after the quiet time; a later instant
moves the due time to its own quiet time's end, but never beyond the first arrival plus
the cap; out-of-order and repeated hints join without moving it. A batch is closed by the
first hint at or after its due time, or by the end of the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "page long, batch long, events long, first_ms long, due_ms long, newest_event long"


def fold(hints: Iterable[tuple[int, int]], quiet: int, cap: int) -> Iterator[tuple]:
    """(batch, events, first_ms, due_ms, newest_event) of (ms, event_id) in order of arrival."""
    batch, first, due, newest, seen = 0, None, 0, None, set()
    for ms, event in hints:
        if first is not None and ms >= due:
            yield batch, len(seen), first, due, newest[1]
            batch, first, seen = batch + 1, None, set()
        if first is None:
            first, due, newest, seen = ms, ms + min(quiet, cap), (ms, event), {event}
            continue
        if event not in seen and ms > newest[0]:
            due = max(due, min(ms + quiet, first + cap))
        newest = max(newest, (ms, event))
        seen.add(event)
    if first is not None:
        yield batch, len(seen), first, due, newest[1]


def debounce(hints: DataFrame, quiet_ms: int, cap_ms: int) -> DataFrame:
    """Batches of hints (page, event_id, ms). A page's hints stream past in order of arrival (a column of that name, else their instants); what is held is the open batch."""
    columns = ["page", "batch", "events", "first_ms", "due_ms", "newest_event"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        rows = (row for part in parts for row in zip(part["page"], part["ms"], part["event_id"], strict=True))
        for page, own in groupby(rows, key=lambda row: row[0]):
            for batch in fold(((ms, event) for _, ms, event in own), quiet_ms, cap_ms):
                out.append((page, *batch))
                if len(out) == 8192:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)

    known = hints.filter("page IS NOT NULL AND event_id IS NOT NULL AND ms IS NOT NULL")
    order = ["arrival", "event_id"] if "arrival" in hints.columns else ["ms", "event_id"]
    return known.repartition("page").sortWithinPartitions("page", *order).select("page", "ms", "event_id").mapInPandas(run, SCHEMA)
