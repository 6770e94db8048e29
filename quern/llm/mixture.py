"""Mixing sources to target weights by blocks.

A source's words, its documents end to end by doc_id, are cut into blocks of BLOCK_WORDS
(the last may be shorter). A source's target in words becomes a number of slots, one per
block taken (its blocks times target over size). The slots of each source are dealt to output shards by a multinomial draw
that is seeded by the source's rank; so shards get source counts of a multinomial given
the sources' totals, and every source meets its target to within a block. Slot k of a
source with n blocks takes block pi(k mod n), pi being a pseudorandom permutation of
0..n-1 of its own for each round k div n. Slots and blocks meet in a join on (source,
block index).

Targets: sources in code-point order, null last, weigh WEIGHTS in turn and share all
words; a target stops at MOST times its source's size and the excess is shared again by
weight, until none is above.

Defined results: a null or blank text has size 0 and nothing taken; a null source is a
source; equal rows count each; an empty table gives no rows. Nothing depends on the order
or the partitions of the input, so reruns agree; rows that tie in doc_id and size come by
their texts' hashes, which tell texts of one doc_id apart. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import buffer_of, mix, map_batches, running_sum, saved, word_count, word_spans


@dataclass(frozen=True)
class Mix:
    block_words: int = 128
    shard_slots: int = 4096
    weights: tuple = (1, 2, 3)
    most: int = 3
    seed: int = 11


class Plan(NamedTuple):
    #: doc_id, source, size, row (the text's hash), sid, start: each document's place among its source's words
    docs: DataFrame
    #: sid, source, source_size, target, blocks, slots
    sources: DataFrame
    #: sid, shard, slot, block: what each output shard holds
    slots: DataFrame


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1, chosen by key, takes each x: a Feistel network, walked until it lands below n."""
    n = n.astype(np.uint64)
    half = np.ones(len(n), np.uint64)
    while (grow := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half += grow.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix(right + k * np.uint64(2 * turn + 3) + np.uint64(turn)) & m)
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def targets(sizes: DataFrame, how: Mix) -> DataFrame:
    """(sid, source, source_size, target) of each source; sizes: source, size."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"one": F.lit(1).cast("long"), "all": F.lit(0).cast("long")})
    ranked = saved(running_sum(by, "all", [F.col("source").isNull(), F.col("source")], "one", "sid").drop("one", "all"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in how.weights]), (F.col("sid") % len(how.weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", (F.col("source_size") * how.most).cast("double"))
    level = 0.0
    while True:  # each pass takes one sum over the sources; the level only rises
        above = F.col("most") < level * F.col("weight")
        total, capped, open_weight = ranked.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        then = (total - capped) / open_weight if total and open_weight else level
        if then <= level:
            break
        level = then
    return ranked.select("sid", "source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def _dealt(sources: DataFrame, shards: int, how: Mix) -> DataFrame:
    """(sid, blocks, shard, first, count): which run of a source's slots each shard gets."""

    def step(batch: pa.RecordBatch):
        for sid, blocks, slots in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            counts = np.random.Generator(np.random.PCG64([how.seed, sid])).multinomial(slots, np.full(shards, 1 / shards))
            first = np.cumsum(counts) - counts
            got = np.flatnonzero(counts)
            for at in range(0, len(got), 65536):
                g = got[at : at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), v)) for v in (sid, blocks)] + [pa.array(v) for v in (g, first[g], counts[g])], ["sid", "blocks", "shard", "first", "count"])

    return map_batches(sources.select("sid", "blocks", "slots"), step, "sid long, blocks long, shard long, first long, count long")


def _slots(dealt: DataFrame, how: Mix) -> DataFrame:
    def step(batch: pa.RecordBatch):
        sid, blocks, shard, first, count = (batch.column(k).to_numpy() for k in range(5))
        at = 0
        total = np.cumsum(count)
        while at < len(sid):  # some 2**18 slots at once
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 18), "right")))
            c = count[at:end]
            s, n, h = (np.repeat(v[at:end], c) for v in (sid, blocks, shard))
            slot = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[at:end], c)
            key = mix(s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix((slot // n).astype(np.uint64) + np.uint64(how.seed)))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (s, h, slot, permuted(slot % n, n, key))], ["sid", "shard", "slot", "block"])
            at = end

    return map_batches(dealt.repartition("sid", "shard"), step, "sid long, shard long, slot long, block long")


def plan(df: DataFrame, how: Mix = Mix()) -> Plan:  # noqa: B008  (frozen)
    """The whole mix of documents (doc_id, source, text)."""
    docs = saved(df.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("row")), "sizes")
    wide = targets(docs.select("source", "size"), how)
    block = F.lit(how.block_words)
    sources = wide.withColumn("blocks", F.ceil(F.col("source_size") / block))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("slots", F.round(F.col("blocks") * share).cast("long"))
    sources = saved(sources, "targets")
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    placed = docs.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.source", "d.size", "d.row", "s.sid")
    placed = running_sum(placed, "sid", [F.col("doc_id"), F.col("size"), F.col("row")], "size", "start")
    dealt = _dealt(sources.filter("slots > 0"), max(1, -(-total // how.shard_slots)), how)
    return Plan(placed, sources, _slots(dealt, how))


def pieces(docs: DataFrame, how: Mix) -> DataFrame:
    """One row for each block that a document has words of: sid, start, doc_id, size, block, skip (words before), words."""
    size = F.lit(how.block_words)
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)
    cut = docs.filter("size > 0").select("sid", "start", "doc_id", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * size)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
    return cut.withColumns({"skip": begin - F.col("start"), "words": end - begin})


def used_pieces(made: Plan, how: Mix) -> DataFrame:
    """pieces() with ``uses``: how many slots took their block."""
    uses = made.slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    return pieces(made.docs, how).join(uses.hint("merge"), ["sid", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)).cast("long"))


def taken(df: DataFrame, how: Mix = Mix()) -> DataFrame:  # noqa: B008
    """Per document: doc_id, size, source_size, target of its source, and the words that the mix takes of it."""
    made = plan(df, how)
    got = used_pieces(made, how).groupBy("sid", "start", "doc_id", "size").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    none = made.docs.filter("size = 0").select("sid", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    rows = got.unionByName(none).join(made.sources.select("sid", "source_size", "target"), "sid")
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(df: DataFrame, how: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The documents as mixed, with df's columns: a row for each copy of a document that the mix takes words of.

    Copy c of a document holds its words of the blocks that c or more slots took, in
    order; runs of words that aren't next to each other are joined by a line feed. So a
    document's rows hold ``taken`` words in all. n_chars, if there, is set anew.
    """
    made = plan(df, how)
    # a document's start is its key: it's unique within the source for all that have words
    key = made.docs.filter("size > 0").select("sid", "start", "doc_id", "row")
    got = used_pieces(made, how).filter("uses > 0").groupBy("sid", "start").agg(F.sort_array(F.collect_list(F.struct("skip", "words", "uses"))).alias("_taken"))
    # rows of equal doc_id and text share a list of what is taken, in order, and are numbered; doc_id
    # goes into an array, where null equals null. Numbers and join deal texts out by the same keys: one shuffle
    keys = ["_sid", "_id", "_row"]
    left = key.join(got.hint("merge"), ["sid", "start"]).groupBy(F.col("sid").alias("_sid"), F.array("doc_id").alias("_id"), F.col("row").alias("_row"))
    left = left.agg(F.sort_array(F.collect_list(F.struct("start", "_taken"))).alias("_all"))
    right = df.alias("d").join(made.sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    right = right.select("d.*", F.col("s.sid").alias("_sid"), F.array("d.doc_id").alias("_id"), F.xxhash64("d.text").alias("_row"))
    right = right.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("text")))
    names = df.columns
    met = right.join(left.hint("merge"), keys).filter(F.col("_nth") <= F.size("_all")).select(*names, F.element_at("_all", F.col("_nth"))["_taken"].alias("_taken"))
    at = names.index("text")

    def step(batch: pa.RecordBatch):
        data, offsets = buffer_of(batch.column(at))
        starts, ends, first = word_spans(data, offsets)
        rows, texts = [], []
        for k, runs in enumerate(batch.column(len(names)).to_pylist()):
            own = first[k]
            for copy in range(1, max(r["uses"] for r in runs) + 1):
                spans: list[list[int]] = []
                for r in runs:
                    if r["uses"] >= copy:
                        if spans and spans[-1][1] == r["skip"]:
                            spans[-1][1] += r["words"]
                        else:
                            spans.append([r["skip"], r["skip"] + r["words"]])
                texts.append(b"\n".join(data[starts[own + a] : ends[own + b - 1]].tobytes() for a, b in spans).decode())
                rows.append(k)
        out = batch.take(pa.array(rows, pa.int32()))
        columns = [pa.array(texts, pa.string()) if k == at else out.column(k) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    out = map_batches(met, step, schema, "text")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
