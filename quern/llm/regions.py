"""Exact links among sets that meet in cells: pivots, regions, windows and recursion.

Jaccard distance is a metric. With T the largest distance of a link:

1. Regions. The pivot of a cell is the member that meets most others in all its cells; a
   pivot's region is all members of its cells, and each is compared with it. Members
   within T of the pivot are linked to it; a region whose members all are is done.
2. Windows. A member of another region goes to its ring of width T around the pivot and,
   as a boundary member, to the next one: by the triangle inequality two linked members
   share one of these. Two members that one pivot links need no comparison.
3. Recursion. A ring in which over LEAF members are open (not linked to the pivot that
   links most) gets a pivot from these, for as long as a round leaves a tenth fewer. The
   other rings are joined by pairs of blocks: the open ones with all.

Pairs within a region are never listed: pivots emit their own links, blocks a spanning
forest. A hot region is dealt to parts of SPREAD members, each with a copy of its pivot,
and members stream past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import SLICE_BYTES, drop_saved, saved, slices

#: Open members of a ring that are joined without another pivot; members of a block; members that stream past one copy of a pivot.
LEAF = 2048
#: Rounds of pivots at most: each takes one bit of the mask of a member's links.
MOST_ROUNDS = 60
BLOCK = 512
SPREAD = 1024
#: Elements of sets, and columns of an incidence matrix, that one step of a comparison holds.
ELEMENTS = 2 << 20
WIDTH = 1 << 13
#: What a column of payloads (texts, or sets as bytes) holds: sorted arrays of distinct hashes.
Sets = Callable[[pa.Array], list[np.ndarray]]


class Rule(NamedTuple):
    """Words to a shingle, and the least similarity as percent."""

    words: int = 3
    percent: int = 90

    def least(self, size: int) -> int:
        """The fewest elements that a set of this size shares with any that it links with."""
        return -(-size * self.percent // 100)

    def linked(self, shared: int, union: int) -> bool:
        return 100 * shared >= self.percent * union

    def ring(self, shared: int, union: int) -> int:
        """Which ring of width T around the pivot."""
        return (union - shared) * 100 // (union * (100 - self.percent)) if self.percent < 100 else 0


def stored_sets(column: pa.Array) -> list[np.ndarray]:
    """Sets from a binary column of hashes, which may be repeated and in any order."""
    return [np.unique(np.frombuffer(x.as_buffer(), "<u8")) for x in column]


def pivoted(members: DataFrame) -> DataFrame:
    """(cell, pivot, node) of members (cell, node): the regions, each under its pivot as cell."""
    many = saved(members.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "cell-sizes")
    own = saved(members.join(many.hint("merge"), "cell").select("cell", "node", "n"), "cells")
    weight = saved(own.groupBy("node").agg(F.sum("n").alias("weight")), "cell-weights")
    ranked = own.join(weight.hint("merge"), "node")
    chosen = saved(ranked.groupBy("cell").agg(F.max(F.struct("weight", "node")).alias("best")).select("cell", F.col("best.node").alias("pivot")), "cell-pivots")
    pairs = own.join(chosen.hint("merge"), "cell").filter("node <> pivot").select(F.col("pivot").alias("cell"), "pivot", "node").distinct()
    pairs = saved(pairs, "regions")
    for done in (many, own, weight, chosen):
        drop_saved(done)
    return pairs


def compared(pairs: DataFrame, held: DataFrame, sets_of: Sets, rule: Rule) -> DataFrame:
    """pairs (cell, pivot, node, mask, was) with each node's ring around the pivot and whether it is linked; held: node, payload."""
    sizes = saved(pairs.groupBy("cell", "pivot").agg(F.count("*").alias("n")), "region-sizes")
    salts = F.ceil(F.col("n") / F.lit(SPREAD)).cast("int")
    members = pairs.join(sizes.drop("pivot").hint("merge"), "cell")
    routes = members.select("cell", F.pmod(F.xxhash64("node"), salts).cast("int").alias("part"), F.lit(True).alias("member"), "pivot", "node", "mask", "was")
    none = F.lit(0).cast("long")
    own = sizes.select("cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("part"), F.lit(False).alias("member"), "pivot", F.col("pivot").alias("node"), none.alias("mask"), none.alias("was"))
    sent = routes.union(own).join(held.hint("merge"), "node").select("cell", "part", "member", "pivot", "node", "mask", "was", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)  # the pivot's rows come before its members'
        for batch in batches:
            for part in slices(batch, "payload", SLICE_BYTES):
                sets, member = sets_of(part.column(7)), part.column(2).to_pylist()
                keep, ring, linked = [], [], []
                for k, x in enumerate(sets):
                    if not member[k]:
                        centre = np.array(x)
                        continue
                    shared = len(np.intersect1d(x, centre, assume_unique=True))
                    union = len(x) + len(centre) - shared
                    keep.append(k)
                    ring.append(rule.ring(shared, union))
                    linked.append(rule.linked(shared, union))
                rows = part.select(["cell", "pivot", "node", "mask", "was"]).take(pa.array(keep, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ring, pa.int32()), pa.array(linked, pa.bool_())], ["cell", "pivot", "node", "mask", "was", "ring", "linked"])

    ordered = sent.repartition("cell", "part").sortWithinPartitions("cell", "part", "member")
    return ordered.mapInArrow(run, "cell long, pivot long, node long, mask long, was long, ring int, linked boolean")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share; large sets are taken by ranges of their hashes."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    steps = max(1, -(-sum(map(len, sets)) // ELEMENTS))
    edges = [np.uint64((1 << 64) * k // steps) for k in range(1, steps)]
    cuts = [np.r_[0, np.searchsorted(s, edges), len(s)].astype(np.int64) for s in sets] if edges else [np.array([0, len(s)]) for s in sets]
    for step in range(steps):
        parts = [s[c[step] : c[step + 1]] for s, c in zip(sets, cuts, strict=True)]
        owner = np.repeat(np.arange(n), [len(x) for x in parts])
        _, element, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        keep = times[element] > 1
        owner, element = owner[keep], element[keep]
        if not len(element):
            continue
        order = np.argsort(element, kind="stable")
        owner, element = owner[order], np.cumsum(np.r_[0, np.diff(element[order]) > 0])
        width = min(WIDTH, int(element[-1]) + 1)
        at = np.searchsorted(element, np.arange(0, element[-1] + 1 + width, width))
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            dense = np.zeros((n, width), np.float32)
            dense[owner[a:b], element[a:b] - k * width] = 1
            out += dense @ dense.T
    return out.astype(np.int64)


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """A spanning forest of the links a[k], b[k]."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = root.setdefault(up, up)
            k = root[k]
        return k

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a, b, strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[rx] = ry
            out[0].append(x)
            out[1].append(y)
    return out


def joined_rings(rings: DataFrame, held: DataFrame, sets_of: Sets, rule: Rule) -> DataFrame:
    """(a, b): links that connect what is linked within each ring; rings: cell, node, mask, open, opens, n.

    Open members are dealt to blocks that meet each other and those of the rest, so that a
    large ring spreads over tasks. Two members with a common bit in mask are linked already.
    """
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sized = rings.withColumns({"ours": blocks(F.col("opens")), "rest": blocks(F.col("n") - F.col("opens"))})
    own = F.pmod(F.xxhash64("node"), F.when(F.col("open"), F.col("ours")).otherwise(F.col("rest"))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    among = F.transform(upto(F.col("ours")), lambda k: meet(F.least("own", k), F.greatest("own", k)))
    with_rest = F.transform(upto(F.col("rest")), lambda k: meet(F.col("own"), F.col("ours") + k))
    with_open = F.transform(upto(F.col("ours")), lambda k: meet(k, F.col("ours") + F.col("own")))
    dealt = sized.withColumn("own", own).select("cell", "node", "mask", F.explode(F.when(F.col("open"), F.concat(among, with_rest)).otherwise(with_open)).alias("at"))
    dealt = dealt.select("cell", "at.i", "at.j", "node", "mask").join(held.hint("merge"), "node")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()  # the forest follows the order of members, so that reruns agree
        if table.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        nodes, mask = (table.column(k).to_numpy() for k in ("node", "mask"))
        sets = sets_of(table.column("payload").chunk(0))
        size = np.array([len(x) for x in sets])
        shared = shared_counts(sets)
        near = 100 * shared >= rule.percent * (size[:, None] + size[None, :] - shared)
        near &= (mask[:, None] & mask[None, :]) == 0
        at = np.nonzero(np.triu(near, 1))
        a, b = forest(nodes[at[0]].tolist(), nodes[at[1]].tolist())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.select("cell", "i", "j", "node", "mask", "payload").groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long")


def _open(level: Column, depth: int) -> Column:
    """Whether a member is open at the ring's level."""
    bit = F.lit(False)
    for k in range(depth + 1):
        bit = F.when(level == k, F.col("mask").bitwiseAND(F.lit(1 << k)) == 0).otherwise(bit)
    return bit


def connected(members: DataFrame, held: DataFrame, sets_of: Sets, rule: Rule, most: int = MOST_ROUNDS) -> DataFrame:
    """(a, b): exact links that connect all sets that share a cell and have the rule's similarity.

    members: cell long, node long, distinct; held: node, payload (null-free) of each of the nodes.
    After ``most`` rounds of pivots (MOST_ROUNDS at most) the rings that are still large are
    joined by blocks like the others.
    """
    if not 0 <= most <= MOST_ROUNDS:
        raise ValueError(f"0 to {MOST_ROUNDS} rounds of pivots")
    if not members.limit(1).count():
        return members.select(F.col("node").alias("a"), F.col("node").alias("b"))
    everything = F.lit((1 << 62)).cast("long")
    regions = pivoted(members)
    pairs = regions.select("cell", "pivot", "node", F.lit(0).cast("long").alias("mask"), everything.alias("was"))
    links, depth = [], 0
    while True:
        done = saved(compared(pairs, held, sets_of, rule), "compared")
        links.append(done.filter("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        mask = F.when(F.col("linked"), F.col("mask").bitwiseOR(F.lit(1 << depth))).otherwise(F.col("mask"))
        live = saved(done.groupBy("cell").agg(F.count("*").alias("n"), F.min("linked").alias("all")).filter("n > 1 AND NOT all").select("cell"), "open-regions")
        ringed = done.join(live.hint("merge"), "cell").select("cell", "node", mask.alias("mask"), "was", F.explode(F.array("ring", F.col("ring") + 1)).alias("ring"))
        ringed = saved(ringed.select(F.xxhash64("cell", "ring", F.lit(depth)).alias("cell"), "node", "mask", "was"), "rings")
        counts = [F.struct(F.count_if(F.col("mask").bitwiseAND(F.lit(1 << k)) == 0).alias("opens"), F.lit(k).alias("level")) for k in range(depth + 1)]
        sized = ringed.groupBy("cell").agg(F.count("*").alias("n"), (F.least(*counts) if depth else counts[0]).alias("least"), F.min("was").alias("before")).filter("n > 1 AND least.opens > 0")
        sized = saved(sized.select("cell", "n", "least.opens", "least.level", ((F.col("least.opens") > LEAF) & (F.col("least.opens") <= 0.9 * F.col("before")) & F.lit(depth < most)).alias("large")), "ring-sizes")
        marked = ringed.join(sized.hint("merge"), "cell").withColumn("open", _open(F.col("level"), depth))
        links.append(saved(joined_rings(marked.filter("NOT large"), held, sets_of, rule), "ring-links"))
        if depth == most or not sized.filter("large").limit(1).count():
            break
        again = saved(marked.filter("large").select("cell", "node", "mask", "open", F.col("opens").alias("was")), "large-rings")
        chosen = saved(again.filter("open").groupBy("cell").agg(F.min_by("node", F.xxhash64("node", F.lit(depth))).alias("pivot")), "ring-pivots")
        pairs = again.join(chosen.hint("merge"), "cell").filter("node <> pivot").select("cell", "pivot", "node", "mask", "was")
        drop_saved(ringed)
        depth += 1
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    return found
