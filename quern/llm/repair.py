"""Repair of conversation structure: the cheapest edits that make the turns alternate.

Turns are judged (blank, duplicate, truncated), and a dynamic programme over four states
(nothing yet, after the system turn, after a user, after an assistant) finds the cheapest
edits Keep, Rerole, Insert and Delete after which the roles' initials read ``(s?(ua)+)?``;
of equally cheap ones the least by code point.

Square-root checkpoints: a conversation's turns lie in blocks that grow by one unit each,
so n turns make about sqrt(n) blocks of at most about sqrt(n) units. A cost vector
backwards (the cheapest way to the end from each state) is stored at the ends of blocks
alone; block by block the vectors inside are computed again while walking forward, and
each step takes the least letter that is tight. Blocks are rows of their own, so the walk
of one long conversation is spread over tasks; what goes through one task in order is a
vector and a state for each block.

Defined results: null roles and texts are one space; turns go by turn (nulls first), role,
the text's first 64 characters and its digest; repeated rows are counted before anything is
shuffled by order, and all but the first are duplicates; a null conv_id is a conversation.
A text's digest is taken in order, so the blocks of one conversation stream through one
task there, in memory of one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import WORD, running_sum, saved

NEVER = 1 << 60
START, OPENED, ASKED, ANSWERED = range(4)
#: state -> the state after the next user or assistant turn
NEXT = (ASKED, ASKED, ANSWERED, ASKED)
#: what that turn is
ROLE = ("user", "user", "assistant", "user")
#: Codes of turns: the initial's class, and whether it must go or is truncated.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
MUST_GO, TRUNCATED = 4, 8
KEEPS = {(START, SYSTEM): OPENED, (START, USER): ASKED, (OPENED, USER): ASKED, (ANSWERED, USER): ASKED, (ASKED, ASSISTANT): ANSWERED}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


@dataclass(frozen=True)
class Costs:
    delete: int = 3
    insert: int = 2
    rerole: int = 2
    truncated: int = 1
    #: Turns of the first block; each further block has as many more.
    unit: int = 1024


def closed(v: list[int], costs: Costs) -> list[int]:
    """Costs to the end from each state, where turns may also be inserted first."""
    for _ in range(2):
        v = [min(c, costs.insert + v[NEXT[s]]) for s, c in enumerate(v)]
    return v


def last(costs: Costs) -> list[int]:
    return closed([0, NEVER, NEVER, 0], costs)


def before(code: int, copies: int, after: list[int], costs: Costs) -> list[int]:
    """The vector before ``copies`` equal turns, of which all but the first must go."""
    gone = costs.delete * (copies - 1)
    v = [costs.delete + gone + c for c in after]
    if not code & MUST_GO:
        extra = gone + (costs.truncated if code & TRUNCATED else 0)
        for s in range(4):
            kept = KEEPS.get((s, code & 3))
            if kept is not None:
                v[s] = min(v[s], extra + after[kept])
            v[s] = min(v[s], extra + costs.rerole + after[NEXT[s]])
    return closed(v, costs)


def vectors(turns: list[tuple[int, int]], after: list[int], costs: Costs) -> list[list[int]]:
    """The vector before each turn of a block and, last, after it."""
    out = [after]
    for code, copies in reversed(turns):
        out.append(before(code, copies, out[-1], costs))
    return out[::-1]


def walk(turns: list[tuple[int, int]], held: list[list[int]], state: int, final: bool, costs: Costs) -> tuple[str, int]:
    """The least tight edits of a block from a state, and the state after it; what is inserted at the very end belongs to the final block."""
    letters = []
    for at, (code, copies) in enumerate(turns):
        now, after, gone = held[at], held[at + 1], costs.delete * (copies - 1)
        while True:
            if now[state] == costs.delete + gone + after[state]:
                letters.append("D")
            elif now[state] == costs.insert + now[NEXT[state]]:
                letters.append("I")
                state = NEXT[state]
                continue
            else:
                extra = gone + (costs.truncated if code & TRUNCATED else 0)
                kept = KEEPS.get((state, code & 3))
                if kept is not None and now[state] == extra + after[kept]:
                    letters.append("K")
                    state = kept
                else:
                    letters.append("R")
                    state = NEXT[state]
            break
        letters.append("D" * (copies - 1))
    while final and held[-1][state]:
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


def edited(audit: str, state: int, turns: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that edits leave, from the turns (role, text, copies) of a block."""
    left = 0
    role = text = ""
    for letter in audit:
        if letter == "I":
            yield letter, ROLE[state], ""
            state = NEXT[state]
            continue
        if not left:
            role, text, left = next(turns)
        left -= 1
        if letter == "R":
            yield letter, ROLE[state], text
            state = NEXT[state]
        elif letter == "K":
            yield letter, role, text
            state = KEEPS[state, "sua".index(role[0])]


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most 10,000 rows, or some megabytes of the column at ``weight``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or "") if weight is not None else 0
        if len(held) == 10_000 or size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def in_groups(df: DataFrame, keys: int, by: list[str], order: list[Column], step: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str, weight: int | None = None) -> DataFrame:
    """df dealt by columns, sorted within each task, and each group of rows of equal first ``keys`` columns streamed through step(key, rows)."""
    names = [tuple(x.split(" ", 1)) for x in schema.split(", ")]
    arrow = pa.schema([(n, _TYPES[t]) for n, t in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = (out for key, group in groupby(rows, lambda r: r[:keys]) for out in step(key, group))
        yield from _batches(made, arrow, weight)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def keyed(df: DataFrame) -> DataFrame:
    """(k, conv_id, turn, role, text), nulls of role and text as one space; k names the conversation and is never null."""
    space = F.lit(" ")
    return df.select(F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit("")).alias("k"), "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def placed(df: DataFrame, costs: Costs) -> DataFrame:
    """Distinct turns of each conversation with their copies, place and block; written to the shared folder."""
    counted = keyed(df).groupBy("k", "conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = counted.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("digest")]
    unit = F.floor(F.col("pos") / costs.unit).cast("long")
    block = F.floor((F.sqrt(8 * unit + 1) - 1) / 2).cast("long")
    return saved(running_sum(rows, "k", order, "copies", "pos").withColumn("block", block), "turns")


def judged(turns: DataFrame) -> DataFrame:
    """(k, block, pos, copies, code, blank, duplicate, truncated): each distinct turn's code, and how many of its copies have which first fault."""
    marks = turns.select(
        "k", "block", "pos", "copies", "digest",
        F.coalesce(F.array_position(F.array(*[F.lit(x) for x in "sua"]), F.left("role", F.lit(1))) - 1, F.lit(OTHER)).alias("initial"),
        (~F.rlike("text", F.lit(WORD))).alias("is_blank"),
        (~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))).alias("is_cut"),
    )
    first = marks.groupBy("k", "digest").agg(F.min("pos").alias("pos")).select("k", "pos", F.lit(True).alias("first"))
    row = marks.join(first, ["k", "pos"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    initial = F.when(F.col("initial") < 0, OTHER).otherwise(F.col("initial"))
    go = F.col("is_blank") | ~F.col("first")
    cut = ~go & F.col("is_cut")
    zero = F.lit(0).cast("long")
    return row.select(
        "k", "block", "pos", "copies",
        (initial + F.when(go, MUST_GO).otherwise(0) + F.when(cut, TRUNCATED).otherwise(0)).cast("long").alias("code"),
        F.when(F.col("is_blank"), F.col("copies")).otherwise(zero).alias("blank"),
        F.when(F.col("is_blank"), zero).otherwise(F.col("copies") - F.col("first").cast("long")).alias("duplicate"),
        cut.cast("long").alias("truncated"),
    )


def checkpoints(coded: DataFrame, costs: Costs) -> DataFrame:
    """(k, block, vector): the costs to the end from each state after every block but a conversation's last."""

    def matrix(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        if not key[1]:
            yield *key, None
            return
        turns = [r[2:4] for r in rows]
        units = [[0 if s == t else NEVER for s in range(4)] for t in range(4)]
        columns = []
        for v in units:
            for code, copies in reversed(turns):
                v = before(code, copies, v, costs)
            columns.append(v)
        yield *key, [c for v in columns for c in v]

    def backwards(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        v = None
        for _, block, m in rows:
            if v is not None:
                yield *key, block, v
            v = v or last(costs)
            v = m and [min(m[4 * t + s] + v[t] for t in range(4)) for s in range(4)]

    rows = coded.select("k", "block", "code", "copies", "pos")
    made = in_groups(rows, 2, ["k", "block"], [F.col("pos")], matrix, "k string, block long, matrix array<long>")
    return in_groups(made, 1, ["k"], [F.col("block").desc()], backwards, "k string, block long, vector array<long>")


def edits(coded: DataFrame, costs: Costs) -> DataFrame:
    """(k, block, state, audit, cost, illegal): each block's edits, the state before it, and in a conversation's first block the whole cost.

    illegal counts the neighbouring turns in the block, and the turn before it, whose initials are none of su, ua and au.
    """

    def walks(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        rows = list(rows)
        vector, turns = rows[0][2], [r[3:5] for r in rows]
        held = vectors(turns, vector or last(costs), costs)
        initials = [code & 3 for code, _ in turns]
        illegal = sum(copies - 1 for _, copies in turns) + sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
        for state in range(4) if key[1] else (START,):
            audit, then = walk(turns, held, state, vector is None, costs)
            yield *key, state, then, audit, held[0][state], illegal, initials[0], initials[-1]

    def chosen(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        state, end = START, None
        for block, ways in groupby(rows, lambda r: r[1]):
            _, _, _, then, audit, cost, illegal, first, final = next(w for w in ways if w[2] == state)
            yield *key, block, state, audit, 0 if block else cost, illegal + (end is not None and (end, first) not in LEGAL)
            state, end = then, final

    ends = checkpoints(coded, costs)
    rows = coded.join(ends, ["k", "block"], "left").select("k", "block", "vector", "code", "copies", "pos")
    made = in_groups(rows, 2, ["k", "block"], [F.col("pos")], walks, "k string, block long, state long, then long, audit string, cost long, illegal long, first long, final long", 4)
    return in_groups(made, 1, ["k"], [F.col("block"), F.col("state")], chosen, "k string, block long, state long, audit string, cost long, illegal long", 3)


@dataclass(frozen=True)
class Repair:
    """turns: placed(); coded: judged(); plan: edits(). All but the given rows lie in the shared folder."""

    turns: DataFrame
    coded: DataFrame
    plan: DataFrame

    def _rows(self) -> DataFrame:
        """Each block's edits, then its turns in order: (k, block, pos, audit, state, role, text, copies)."""
        no = F.lit(None)
        heads = self.plan.select("k", "block", F.lit(-1).cast("long").alias("pos"), "audit", "state", no.cast("string").alias("role"), no.cast("string").alias("text"), no.cast("long").alias("copies"))
        return heads.unionAll(self.turns.select("k", "block", "pos", no.cast("string"), no.cast("long"), "role", "text", "copies"))

    def repaired(self) -> DataFrame:
        """(k, block, at, edit, role, text): the turns that stay, in order of block and at; empty ones were inserted."""

        def step(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
            head = next(rows)
            for at, said in enumerate(edited(head[3], head[4], (r[5:8] for r in rows))):
                yield *key, at, *said

        return in_groups(self._rows(), 2, ["k", "block"], [F.col("pos")], step, "k string, block long, at long, edit string, role string, text string", 5)

    def digests(self) -> DataFrame:
        """(k, audit, repaired_sha256) of each conversation with turns."""

        def digest(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
            sha, audits, between = hashlib.sha256(), [], ""
            for _, block in groupby(rows, lambda r: r[1]):
                head = next(block)
                audits.append(head[3])
                for _, role, text in edited(head[3], head[4], (r[5:8] for r in block)):
                    sha.update(f"{between}{role}:{text}".encode())
                    between = "\n"
            yield *key, "".join(audits), sha.hexdigest()

        return in_groups(self._rows(), 1, ["k"], [F.col("block"), F.col("pos")], digest, "k string, audit string, repaired_sha256 string", 1)


def repair(df: DataFrame, costs: Costs | None = None) -> Repair:
    """The faults and cheapest edits of conversations (conv_id, turn, role, text; other columns are left out)."""
    costs = costs or Costs()
    turns = placed(df, costs)
    coded = saved(judged(turns), "coded")
    return Repair(turns, coded, saved(edits(coded, costs), "edits"))


def repair_digest(df: DataFrame, conversations: DataFrame, costs: Costs | None = None) -> DataFrame:
    """Per conv_id of conversations: gaps, faults, cost and edits of its rows in df; zeros and empty digests where df has none."""
    made = repair(df, costs)
    gap = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = made.turns.groupBy("k").agg(F.coalesce(gap, F.lit(0)).cast("long").alias("gaps"))
    faults = made.coded.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    total = made.plan.groupBy("k").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    every = keyed(conversations.select("conv_id", F.lit(0).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))).select("k", "conv_id").distinct()
    rows = every
    for part in (gaps, faults, total, made.digests()):
        rows = rows.join(part, "k", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(df: DataFrame) -> DataFrame:
    """Rows with the faults that crc32('conv_id:turn') % 20 names: 0 drops, 1 empties, 2 takes end marks out, 3 repeats, 4 makes it a user's."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(named.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = df.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("_kind"))
    again = F.when(F.col("_kind") == 0, F.array()).when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("_again", F.explode(again)).drop("_kind", "_again")
