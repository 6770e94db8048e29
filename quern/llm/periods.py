"""Periodic runs of words: an online dynamic programme over sparse diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
of at least ``least`` words and ``power`` periods that no neighbouring word extends. On the
table of matches word i = word i - d, a run is a diagonal d = q: its match length grows by
one with each word whose earlier occurrence lies d before, and where it ends the run is
complete and emitted.

Every earlier occurrence of every word would be a square of a frequent word's count. Only
one diagonal a word and scale is kept active: for periods from w/2 to w - 1, w a power of
two, a word stands for the w words that begin there, and only its nearest earlier
occurrence counts. That loses nothing where power is 3 or more: inside a run of period q
<= w, w words recur at multiples of q alone, so the nearest lag is q at each word whose w
words lie in the run, and 3 q words hold at least one (w <= 2 q). Nor does it add: a
stretch whose nearest lag is d has no smaller period. A scale keeps only words that occur
again at the one before, so texts without repetition stop after a few scales; a text of n
words takes n log n time and n memory whatever its words are.

Words are compared by value, never by hash. Texts are worked on in slices of some
megabytes, a longer text by itself; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import WORD, buffer_of, map_batches, word_spans


@dataclass(frozen=True)
class Rule:
    #: Words that a run has at least.
    least: int = 24
    #: Periods that a run has at least; 3 is the smallest that the method finds whole.
    power: int = 3

    def __post_init__(self):
        if self.power < 3 or self.least < 1:
            raise ValueError("a run has at least three periods and one word")


def diagonals(p: np.ndarray, lag: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the diagonals that words p, in order, extend at their lags, when each has ended.

    A word goes on with the diagonal of the word before it where both have one lag; ``span`` words stand behind each.
    """
    if not len(p):
        return p, p, p
    opens = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(lag) != 0)])
    closes = np.r_[opens[1:], len(p)] - 1
    period = lag[opens]
    start = p[opens] - period
    return start, p[closes] + span - start, period


def runs_of(codes: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period), by start then period, of all runs of texts that lie end to end as word codes; ``bounds`` has each text's first word and all."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(bounds)
    if not len(codes) or sizes.max() < max(rule.least, rule.power):
        return none, none, none
    of = np.repeat(np.arange(len(sizes)), sizes)
    name = of * (int(codes.max()) + 1) + codes  # equal words of two texts differ, so no window repeats across texts
    p = np.arange(len(codes))
    ids = np.full(len(codes), -1)
    held = none
    found, span, longest = [], 1, int(sizes.max()) // rule.power
    while True:
        order = np.argsort(name, kind="stable")
        again = np.r_[False, name[order][1:] == name[order][:-1]]
        number = np.cumsum(~again)
        lag = np.zeros(len(p), np.int64)
        lag[order[1:]] = np.where(again[1:], p[order[1:]] - p[order[:-1]], 0)
        near = (lag >= (span + 1) // 2) & (lag < span)
        if near.any():
            found.append(diagonals(p[near], lag[near], span))
        repeated = again | np.r_[again[1:], False]
        if span > longest or not repeated.any():
            break
        ids[held] = -1
        held = p[order[repeated]]
        ids[held] = number[repeated]
        # twice as many words: a word's own and those that follow them, both of which occur again
        p = np.sort(held)
        p = p[p + span < len(codes)]
        after = ids[p + span]
        p, after = p[after >= 0], after[after >= 0]
        if not len(p):
            break
        name = ids[p] * (len(codes) + 1) + after
        span *= 2
    if not found:
        return none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    enough = (length >= rule.least) & (length >= rule.power * period)
    start, length, period = start[enough], length[enough], period[enough]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The words of a buffer as an Arrow array."""
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    offsets = np.r_[0, np.cumsum(ends - starts)]
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(mark[:-1]) > 0])])



def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule | None = None) -> DataFrame:
    """(key, words long, runs array<struct<start, length, period>>, collapsed string) of every row.

    Runs are in order of start, then period, and count words from 0. collapsed has the
    words joined by one space, without those that some run holds after its first period.
    Null and empty texts have no words and an empty collapsed; repeated rows and null keys
    stay rows of their own; other columns are left out, so their names don't matter.
    """
    rule = rule or Rule()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = buffer_of(batch.column(1))
        starts, ends, bounds = word_spans(data, at)
        words = _words(data, starts, ends, pa.large_binary())
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start, length, period = runs_of(codes, bounds, rule)
        covered = np.zeros(len(codes) + 1, np.int64)
        np.add.at(covered, start + period, 1)
        np.add.at(covered, start + length, -1)
        kept = np.cumsum(covered[:-1]) == 0
        left = np.r_[0, np.cumsum(kept)][bounds]
        lists = pa.LargeListArray.from_arrays(pa.array(left), words.filter(pa.array(kept)))
        collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string())
        first = np.searchsorted(start, bounds)
        inside = start - np.repeat(bounds[:-1], np.diff(first))
        runs = pa.StructArray.from_arrays([pa.array(inside), pa.array(length), pa.array(period)], fields=list(RUN))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), runs), collapsed], [key, "words", "runs", "collapsed"])

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), step, f"`{key}` {kind}, words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", text)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; ties go to the smallest start, then period. Null for none."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def looped(text: Column, key: Column) -> Column:
    """The text with its tail made periodic for a tenth of the keys, the lengths by the key's crc32; the words joined by one space there.

    With g = crc32 div 10 of a key whose crc32 is a multiple of 10 and n words, word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). Other texts,
    those without words and those of a null key stay.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def put(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        head = F.slice(words, F.lit(1), a)
        loop = F.slice(words, a + 1, p)
        again = F.flatten(F.array_repeat(loop, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(head, F.slice(again, F.lit(1), n - a)), " ")

    some = F.rlike(text, F.lit(WORD))
    return F.when((h % 10 == 0) & some, put(words)).otherwise(text)


def run_digest(df: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Per document (texts as they are): the number of runs, the strongest one and digests of all runs and of the collapsed text."""
    best = strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    made = find_runs(df, rule=rule).withColumn("best", best)
    return made.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
        F.col("words").alias("n_words"),
    )
