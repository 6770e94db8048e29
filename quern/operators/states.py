"""State machines as folds: rows of a key stream past in order, and only the key's state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: step(state, row) -> (state, columns to add); state is None before a key's first row.
Step = Callable[[dict | None, dict], tuple[dict | None, dict]]


def folded(df: DataFrame, key: str, order: list[str], step: Step, added: str) -> DataFrame:
    """df with the columns ``added`` that step gives for each row, rows of a key in order."""
    names = [x.split()[0] for x in added.split(", ")]
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, {added}"
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    tail = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in added.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != now:
                    now, state = row[key], None
                state, made = step(state, row)
                out.append(made)
            more = pa.RecordBatch.from_pylist(out, tail)
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.columns], [*batch.schema.names, *names])

    return df.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def lease(state: dict | None, row: dict) -> tuple[dict, dict]:
    """op acquire, renew or release by holder at now_ms for ttl_ms: one holder at a time, a fence that grows with each acquisition.

    A lease lasts whole seconds, rounded up, 1 to 3600.
    """
    s = dict(state or {"holder": None, "until": 0, "fence": 0})
    seconds = min(max(-(-row["ttl_ms"] // 1000), 1), 3600)
    live = s["holder"] is not None and s["until"] > row["now_ms"]
    mine = live and s["holder"] == row["holder"]
    if row["op"] == "acquire":
        outcome = "busy" if live else "acquired"
        if not live:
            s = {"holder": row["holder"], "until": row["now_ms"] + 1000 * seconds, "fence": s["fence"] + 1}
    elif not mine:
        outcome = "lost"
    elif row["op"] == "renew":
        outcome, s["until"] = "renewed", row["now_ms"] + 1000 * seconds
    else:
        outcome, s["holder"] = "released", None
    return s, {"outcome": outcome, "fence": s["fence"]}


def retry_at(now_ms: int, attempt: int, base_ms: int, most_ms: int) -> int:
    return now_ms + min(base_ms << min(attempt - 1, 40), most_ms)


def inbox(attempts: int = 3, lease_ms: int = 60_000, base_ms: int = 1_000, most_ms: int = 60_000) -> Step:
    """One delivery's life: deliver, claim, complete, retry, permanent, requeue; ``generation`` fences the last four.

    A claim takes what is pending and due, or running with its lease run out; where the
    lease of the last attempt has run out, it goes to failed first. A retry waits longer
    each time; after the last attempt it fails. A requeue starts anew.
    """

    def step(state: dict | None, row: dict) -> tuple[dict | None, dict]:
        op, now = row["op"], row["now_ms"]
        if state is None:
            if op != "deliver":
                return None, {"status": "absent", "generation_now": 0, "attempt": 0}
            state = {"status": "pending", "due": now, "until": 0, "generation": 0, "attempt": 0}
        s = dict(state)
        if op == "claim":
            expired = s["status"] == "running" and s["until"] <= now
            if expired and s["attempt"] >= attempts:
                s["status"] = "failed"
            elif expired or s["status"] == "pending" and s["due"] <= now:
                s |= {"status": "running", "until": now + lease_ms, "generation": s["generation"] + 1, "attempt": s["attempt"] + 1}
        elif op == "requeue":
            if s["status"] == "failed" and row["generation"] == s["generation"]:
                s |= {"status": "pending", "due": now, "attempt": 0, "generation": s["generation"] + 1}
        elif op != "deliver" and s["status"] == "running" and row["generation"] == s["generation"] and s["until"] > now:
            if op == "complete":
                s["status"] = "done"
            elif op == "permanent" or s["attempt"] >= attempts:
                s["status"] = "failed"
            else:
                s |= {"status": "pending", "due": retry_at(now, s["attempt"], base_ms, most_ms)}
        return s, {"status": s["status"], "generation_now": s["generation"], "attempt": s["attempt"]}

    return step


def ledger(state: dict | None, row: dict) -> tuple[dict, dict]:
    """Idempotent requests of a key: op begin, unknown or commit with a request's digest.

    The first begin executes; later ones replay a committed receipt or reconcile what is
    pending or unknown; another digest under the same key is a conflict. A receipt stays.
    """
    if state is None:
        if row["op"] != "begin":
            return {"status": "none", "digest": None}, {"decision": "no_request"}
        return {"status": "pending", "digest": row["digest"]}, {"decision": "execute_once"}
    s = dict(state)
    if s["digest"] is None and row["op"] == "begin":
        return {"status": "pending", "digest": row["digest"]}, {"decision": "execute_once"}
    if s["digest"] is None:
        return s, {"decision": "no_request"}
    if s["digest"] != row["digest"]:
        return s, {"decision": "key_conflict"}
    if row["op"] == "begin":
        return s, {"decision": "replay" if s["status"] == "committed" else "reconcile"}
    if s["status"] != "committed":
        s["status"] = "committed" if row["op"] == "commit" else "unknown"
        return s, {"decision": s["status"]}
    return s, {"decision": "kept"}


def schedule(interval_ms: int, attempts: int = 3, base_ms: int = 60_000, most_ms: int = 3_600_000) -> Step:
    """A schedule's life: register, claim, complete, fail, hold, release, abandon, reconfigure.

    fail waits longer each time and exhausts after ``attempts``; a held schedule isn't
    claimed; abandon drops the running claim; complete starts the next interval.
    """

    def step(state: dict | None, row: dict) -> tuple[dict | None, dict]:
        op, now = row["op"], row["now_ms"]
        if state is None:
            if op != "register":
                return None, {"phase": "absent", "due_ms": None, "failures": 0}
            state = {"phase": "waiting", "due": now + interval_ms, "failures": 0, "held": False}
        s = dict(state)
        if op == "claim" and s["phase"] == "waiting" and not s["held"] and s["due"] <= now:
            s["phase"] = "running"
        elif op == "complete" and s["phase"] == "running":
            s |= {"phase": "waiting", "due": now + interval_ms, "failures": 0}
        elif op == "fail" and s["phase"] == "running":
            s["failures"] += 1
            s |= {"phase": "exhausted"} if s["failures"] >= attempts else {"phase": "waiting", "due": retry_at(now, s["failures"], base_ms, most_ms)}
        elif op in ("hold", "release"):
            s["held"] = op == "hold"
        elif op == "abandon" and s["phase"] == "running":
            s |= {"phase": "waiting", "due": now + interval_ms}
        elif op == "reconfigure" and s["phase"] in ("waiting", "exhausted"):
            s |= {"phase": "waiting", "due": now + interval_ms, "failures": 0}
        return s, {"phase": "held" if s["held"] and s["phase"] == "waiting" else s["phase"], "due_ms": s["due"], "failures": s["failures"]}

    return step


def _joined(a: tuple, b: tuple) -> tuple:
    """Members of two groups: how many, and the newest."""
    return a[0] + b[0], max((x for x in (a[1], b[1]) if x is not None), default=None)


def page_batches(quiet_ms: int, most_ms: int, lease_ms: int, attempts: int = 3) -> Step:
    """One page's batches of hints: hint, claim, complete, retry; ``generation`` fences the last two.

    Hints join the open batch, which is due after a quiet time, though no later than
    most_ms after its first. A claim freezes a due batch under a lease; hints that come
    later open a successor. complete ends the batch whose generation it names while its
    lease holds, and retry gives its members back; so does the next claim once the lease
    has run out. Members that were claimed ``attempts`` times fail instead. Members are
    kept as counts by claims so far, with the newest of each, so the state is bounded.
    """
    none = (0, None)

    def back(s: dict, now: int) -> dict:
        opened = [s["open"][0], *(_joined(s["open"][a + 1], s["frozen"][a]) for a in range(attempts - 1))]
        s = s | {"open": opened, "frozen": [none] * attempts, "until": None, "failed": s["failed"] + s["frozen"][-1][0]}
        return s | {"first": now if s["first"] is None else s["first"], "due": now if s["due"] is None else s["due"]} if any(n for n, _ in opened) else s

    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        s = state or {"open": [none] * attempts, "frozen": [none] * attempts, "first": None, "due": None, "until": None, "generation": 0, "failed": 0}
        op, now = row["op"], row["now_ms"]
        live = s["until"] is not None and s["until"] > now and row["generation"] == s["generation"]
        held, newest = sum(n for n, _ in s["frozen"]), None
        if op == "hint":
            outcome = "joined" if any(n for n, _ in s["open"]) else "opened"
            first = now if s["first"] is None else s["first"]
            s = s | {"open": [_joined(s["open"][0], (1, (now, row["event_id"]))), *s["open"][1:]], "first": first, "due": min(now + quiet_ms, first + most_ms)}
        elif op == "claim":
            s = back(s, now) if s["until"] is not None and s["until"] <= now else s
            whole = (0, None)
            for part in s["open"]:
                whole = _joined(whole, part)
            outcome = "busy" if s["until"] is not None else "none" if not whole[0] else "early" if s["due"] > now else "claimed"
            if outcome == "claimed":
                held, newest = whole[0], whole[1][1]
                s = s | {"open": [none] * attempts, "frozen": s["open"], "first": None, "due": None, "until": now + lease_ms, "generation": s["generation"] + 1}
        elif not live:
            outcome = "lost"
        elif op == "complete":
            outcome, s = "completed", s | {"frozen": [none] * attempts, "until": None}
        else:
            outcome, s = "returned", back(s, now)
        size = held if outcome in ("claimed", "completed") else sum(n for n, _ in s["open"])
        return s, {"outcome": outcome, "generation_now": s["generation"], "size": size, "newest": newest, "failed": s["failed"]}

    return step


def admission(most: int) -> Step:
    """Requests of ``weight`` that run for hold_ms: admitted while what runs weighs ``most`` at most together, else rejected.

    What is rejected never ran, so it takes no room from later ones; room comes back when a
    request's time is over. A request that weighs over ``most`` by itself is never admitted.
    The state is what runs, so at most ``most`` requests of weight 1.
    """

    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        s = state or {"running": [], "peak": 0, "rejected": 0}
        running = [r for r in s["running"] if r[0] > row["now_ms"]]
        active = sum(w for _, w in running)
        fits = active + row["weight"] <= most
        if fits:
            running.append((row["now_ms"] + row["hold_ms"], row["weight"]))
            active += row["weight"]
        s = {"running": running, "peak": max(s["peak"], active), "rejected": s["rejected"] + (not fits)}
        return s, {"admitted": fits, "active": active, "peak": s["peak"], "rejected": s["rejected"]}

    return step
