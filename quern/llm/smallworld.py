"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Equal vectors become one node first. Nodes are dealt to shards by hash; each shard's
graph is built by insertion (layers by hash, LINKS neighbours a layer, twice that on the
lowest, chosen so that neighbours don't hide each other) and written to the shared
folder, where tasks map it. Every node then queries every shard: greedy steps down the
layers, a beam on the lowest, and from each hit a flood over the graph, so that no number
of partners is cut off. Every hit's cosine is checked in double precision.

Before the full run an audit compares nodes sampled by hash, AUDIT and then four times as
many each time, exactly with all nodes, until PARTNERED of them have partners. Those go
through the search; the beam doubles until their mean recall (each node counts once,
whatever the rows of its partners) is GOAL or more. Where the beam reaches MOST_BEAM
below the goal, or all nodes were sampled, every node is compared exactly, by blocks;
beam is 0 then. Vectors of each length have graphs and an audit of their own.

A shard holds at most SHARD nodes; there are at least SHARDS. A block of queries emits
each node's number of partners and a spanning forest of its links, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths don't link; equal rows link with each other; rows of one vec_id are told apart
by their vectors; a null vec_id counts as larger than any other.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.graph import components
from quern.llm.shared import map_batches, mapped, mix, put, saved, shared_dir

LEAST = 0.95
LINKS = 12
BUILD_BEAM = 48
FIRST_BEAM = 16
AUDIT = 256
PARTNERED = 64
MOST_BEAM = 1024
GOAL = 0.99
SHARDS, SHARD = 8, 1 << 16
BLOCK, PART = 512, 8192
NO_ID = (1 << 63) - 1


class Builder:
    """A graph that grows by insertion."""

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(nodes)
        uniform = (mix(nodes.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        self.level = np.minimum((-np.log(np.maximum(uniform, 1e-300)) / np.log(LINKS)).astype(np.int64), 12)
        layers = int(self.level.max(initial=0)) + 1
        self.near = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(layers)]
        self.size = [np.zeros(n, np.int32) for _ in range(layers)]
        self.seen = np.zeros(n, np.int64)
        self.stamp = 0
        self.entry, self.top = 0, int(self.level[0]) if n else 0
        for k in range(1, n):
            self._insert(k)

    def _search(self, q: np.ndarray, entry: list, beam: int, layer: int) -> list:
        self.stamp += 1
        seen, near, size, v = self.seen, self.near[layer], self.size[layer], self.v
        todo, best = [], []
        for score, k in entry:
            seen[k] = self.stamp
            todo.append((-score, k))
            best.append((score, k))
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            score, k = heapq.heappop(todo)
            if len(best) >= beam and -score < best[0][0]:
                break
            ids = near[k, : size[k]]
            ids = ids[seen[ids] != self.stamp]
            if not len(ids):
                continue
            seen[ids] = self.stamp
            for s, j in zip((v[ids] @ q).tolist(), ids.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (s, j))
                    heapq.heappush(todo, (-s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                    heapq.heappush(todo, (-s, j))
        return sorted(best, reverse=True)

    def _diverse(self, found: list, most: int) -> list:
        """The nearest first, but none that is closer to one already chosen than to the new node; then the rest, up to ``most``."""
        if len(found) <= most:
            return [k for _, k in found]
        ids = np.array([k for _, k in found])
        among = (self.v[ids] @ self.v[ids].T).tolist()
        chosen: list[int] = []
        for a, (score, _) in enumerate(found):
            if all(among[a][b] <= score for b in chosen):
                chosen.append(a)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [a for a in range(len(found)) if a not in taken][: most - len(chosen)]
        return ids[chosen].tolist()

    def _insert(self, k: int) -> None:
        q, level = self.v[k], int(self.level[k])
        at = [(float(self.v[self.entry] @ q), self.entry)]
        for layer in range(self.top, level, -1):
            at = self._search(q, at, 1, layer)
        for layer in range(min(self.top, level), -1, -1):
            at = self._search(q, at, BUILD_BEAM, layer)
            near, size = self.near[layer], self.size[layer]
            chosen = self._diverse(at, LINKS)
            near[k, : len(chosen)] = chosen
            size[k] = len(chosen)
            for j in chosen:
                if size[j] < near.shape[1]:
                    near[j, size[j]] = k
                    size[j] += 1
                else:
                    ids = np.append(near[j], k)
                    found = sorted(zip((self.v[ids] @ self.v[j]).tolist(), ids.tolist(), strict=True), reverse=True)
                    kept = self._diverse(found, near.shape[1])
                    near[j, : len(kept)] = kept
                    size[j] = len(kept)
        if level > self.top:
            self.entry, self.top = k, level


class Shard:
    """A graph in the shared folder, for blocks of queries."""

    def __init__(self, folder: str, shard: int, width: int):
        head = mapped(folder, f"{shard}.head", "<i8")
        n, self.entry, layers = (int(x) for x in head[:3])
        self.nodes = mapped(folder, f"{shard}.nodes", "<i8")
        self.units = mapped(folder, f"{shard}.units", "<f8").reshape(n, width)
        self.weight = mapped(folder, f"{shard}.weight", "<i8")
        flat = mapped(folder, f"{shard}.near", "<i4")
        self.near = [flat[: n * 2 * LINKS].reshape(n, 2 * LINKS)]
        for k in range(1, layers):
            begin = n * LINKS * (k + 1)
            self.near.append(flat[begin : begin + n * LINKS].reshape(n, LINKS))

    def _scores(self, q: np.ndarray, query: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.einsum("kd,kd->k", q[query], self.units[to])

    def exact(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, position) with a cosine of LEAST or more."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(self.nodes), PART):
            qi, ni = np.nonzero(q @ self.units[at : at + PART].T >= LEAST)
            found.append((qi, ni + at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, position) found with a cosine of LEAST or more."""
        b, n = len(q), len(self.nodes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.arange(b)
        at = np.full(b, self.entry)
        score = self._scores(q, rows, at)
        for near in self.near[:0:-1]:
            moving = rows
            while len(moving):
                to = near[at[moving]]
                got = np.einsum("qd,qkd->qk", q[moving], self.units[np.maximum(to, 0)])
                got[to < 0] = -2
                best = got.argmax(axis=1)
                value = got[np.arange(len(moving)), best]
                better = value > score[moving]
                moving, best, value, to = moving[better], best[better], value[better], to[better]
                at[moving] = to[np.arange(len(moving)), best]
                score[moving] = value
        seen = np.zeros((b, n), bool)
        seen[rows, at] = True
        ids = np.full((b, beam), -1, np.int64)
        scores = np.full((b, beam), -2.0)
        done = np.ones((b, beam), bool)
        ids[:, 0], scores[:, 0], done[:, 0] = at, score, False
        hits = [(rows[score >= LEAST], at[score >= LEAST])]
        active = rows
        while len(active):
            open_scores = np.where(done[active], -3.0, scores[active])
            pick = open_scores.argmax(axis=1)
            live = open_scores[np.arange(len(active)), pick] > -3
            active, pick = active[live], pick[live]
            if not len(active):
                break
            done[active, pick] = True
            to = self.near[0][ids[active, pick]]
            fresh = (to >= 0) & ~seen[active[:, None], np.maximum(to, 0)]
            qi, ni = np.nonzero(fresh)
            query, node = active[qi], to[qi, ni]
            seen[query, node] = True
            value = self._scores(q, query, node)
            near = value >= LEAST
            hits.append((query[near], node[near]))
            new_scores = np.full(to.shape, -2.0)
            new_scores[qi, ni] = value
            all_scores = np.concatenate([scores[active], new_scores], axis=1)
            top = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
            take = lambda old, new, top=top, active=active: np.take_along_axis(np.concatenate([old[active], new], axis=1), top, axis=1)
            ids[active], done[active] = take(ids, np.where(fresh, to, -1)), take(done, ~fresh)
            scores[active] = np.take_along_axis(all_scores, top, axis=1)
        frontier = tuple(np.concatenate(x) for x in zip(*hits, strict=True))
        found = [frontier]
        while len(frontier[0]):
            to = self.near[0][frontier[1]]
            query = np.repeat(frontier[0], to.shape[1])
            node = to.ravel()
            keep = node >= 0
            query, node = query[keep], node[keep]
            pair = np.unique(query * n + node)
            query, node = pair // n, pair % n
            keep = ~seen[query, node]
            query, node = query[keep], node[keep]
            seen[query, node] = True
            near = self._scores(q, query, node) >= LEAST
            frontier = query[near], node[near]
            found.append(frontier)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@lru_cache(maxsize=64)
def _shard(folder: str, shard: int, width: int) -> Shard:
    return Shard(folder, shard, width)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """A spanning forest of the links (a, b)."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = root.setdefault(up, up)
            k = root[k]
        return k

    out: tuple[list, list] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[rx] = ry
            out[0].append(x)
            out[1].append(y)
    return out


def _clean(df: DataFrame) -> DataFrame:
    """(vec_id, node, unit, digest) of every row; node is null for vectors that link with nothing."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, units = [], []
        for vector in batch.column(1).to_pylist():
            if not vector or None in vector:
                nodes.append(None)
                units.append(None)
                continue
            x = np.array(vector, np.float64)
            size = np.sqrt(x @ x)
            if not (np.isfinite(x).all() and 0 < size < np.inf):
                x = x / np.abs(x).max() if np.isfinite(x).all() and x.any() else None
                size = None if x is None else np.sqrt(x @ x)
            nodes.append(None if x is None else int.from_bytes(hashlib.blake2b(np.array(vector, np.float64).tobytes(), digest_size=8).digest(), "little", signed=True))
            units.append(None if x is None else x / size)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(units, pa.list_(pa.float64()))], ["vec_id", "node", "unit"])

    ids = F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id")
    return map_batches(df.select(ids, F.col("embedding").cast("array<double>").alias("embedding")), step, "vec_id long, node long, unit array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width) if len(column) else np.zeros((0, width))


def build(nodes: DataFrame, width: int, folder: str, shards: int) -> None:
    """Writes the graphs of all shards; nodes: node, unit, weight."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        shard = table.column("shard")[0].as_py()
        ids = table.column("node").to_numpy()
        order = np.argsort(mix(ids.view(np.uint64)), kind="stable")
        units = _matrix(table.column("unit").chunk(0), width)[order]
        made = Builder(units, ids[order])
        put(folder, f"{shard}.nodes", ids[order])
        put(folder, f"{shard}.units", units)
        put(folder, f"{shard}.weight", table.column("weight").to_numpy()[order])
        put(folder, f"{shard}.near", np.concatenate([x.ravel() for x in made.near]))
        put(folder, f"{shard}.head", np.array([len(ids), made.entry, len(made.near)], "<i8"))
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(ids)], pa.int64())})

    shard = F.pmod(F.xxhash64("node"), F.lit(shards))
    # the counts are all that comes back
    got = {r.shard for r in nodes.withColumn("shard", shard).groupBy("shard").applyInArrow(one, "shard long, n long").collect()}
    for k in set(range(shards)) - got:
        for name, kind in (("nodes", "<i8"), ("units", "<f8"), ("weight", "<i8"), ("near", "<i4")):
            put(folder, f"{k}.{name}", np.zeros(0, kind))
        put(folder, f"{k}.head", np.array([0, 0, 1], "<i8"))


def query(nodes: DataFrame, width: int, folder: str, shards: int, beam: int) -> DataFrame:
    """(node, partners, others, a, b): the rows and the other nodes that a node links with, once per node; and links a-b that connect them. A beam of 0 compares exactly."""

    def step(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids, q = part.column(0).to_numpy(), _matrix(part.column(1), width)
            count, others = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for k in range(shards):
                shard = _shard(folder, k, width)
                qi, ni = shard.search(q, beam) if beam else shard.exact(q)
                other = shard.nodes[ni]
                keep = other != ids[qi]
                qi, ni, other = qi[keep], ni[keep], other[keep]
                np.add.at(count, qi, shard.weight[ni])
                np.add.at(others, qi, 1)
                a, b = _forest(ids[qi], other)
                if a:
                    none = pa.nulls(len(a), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "partners", "others", "a", "b"])
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), pa.array(others), none, none], ["node", "partners", "others", "a", "b"])

    return map_batches(nodes.select("node", "unit"), step, "node long, partners long, others long, a long, b long")


def audit(nodes: DataFrame, total: int, width: int, folder: str, shards: int, goal: float = GOAL) -> tuple[int, float]:
    """The beam (0: compare exactly) and its measured recall."""
    size = AUDIT
    while True:
        if size >= total:
            return 0, 1.0
        sample = nodes.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20)) < F.lit(size / total * (1 << 20)))
        exact = query(sample, width, folder, shards, 0).filter("others > 0").select("node", F.col("others").alias("want"))
        want = saved(sample.select("node", "unit").join(exact.hint("merge"), "node"), "vector-audit")
        if want.count() >= PARTNERED:
            break
        size *= 4
    beam = FIRST_BEAM
    while beam <= MOST_BEAM:
        got = query(want, width, folder, shards, beam).filter("node IS NOT NULL").select("node", "others")
        recall = want.select("node", "want").join(got.hint("merge"), "node").agg(F.avg(F.col("others") / F.col("want"))).first()[0]
        if recall >= goal:
            return beam, recall
        beam *= 2
    return 0, 1.0


def searched(nodes: DataFrame, total: int, width: int) -> DataFrame:
    """(node, partners, a, b, beam, recall) of the nodes of one length."""
    spark = nodes.sparkSession
    shards = max(SHARDS, -(-total // SHARD))
    folder = shared_dir(spark, "smallworld")
    build(nodes, width, folder, shards)
    beam, recall = audit(nodes, total, width, folder, shards)
    found = query(nodes, width, folder, shards, beam)
    return found.select("node", "partners", "a", "b", F.lit(beam).cast("long").alias("beam"), F.lit(recall).cast("double").alias("recall"))


def near_duplicates(df: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of df (vec_id, embedding); beam and audited recall besides."""
    spark = df.sparkSession
    rows = saved(_clean(df), "vectors")
    own = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("unit").alias("unit"))
    nodes = saved(own.repartition(spark.sparkContext.defaultParallelism * 2, "node"), "vector-nodes")
    # one row a vector length
    widths = [(r.width, r["count"]) for r in nodes.groupBy(F.size("unit").alias("width")).count().orderBy("width").collect()]
    parts = [saved(searched(nodes.filter(F.size("unit") == width), total, width), "vector-links") for width, total in widths if total > 1]
    alone = nodes.join(spark.createDataFrame([(w,) for w, n in widths if n == 1], "width int").hint("broadcast"), F.size("unit") == F.col("width"))
    none = F.lit(None).cast("long")
    found = alone.select("node", F.lit(0).cast("long").alias("partners"), none.alias("a"), none.alias("b"), F.lit(0).cast("long").alias("beam"), F.lit(1.0).alias("recall"))
    for part in parts:
        found = found.union(part)
    roots = components(found.filter("a IS NOT NULL").select("a", "b"))
    counts = found.filter("node IS NOT NULL").select("node", "partners", "beam", "recall")
    rooted = nodes.select("node", "weight", "least").join(counts.hint("merge"), "node").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = rooted.join(least.hint("merge"), "root").select("node", (F.col("weight") - 1 + F.col("partners")).alias("n_links"), "component_id", "beam", "recall")
    shown = lambda c: F.nullif(c, F.lit(NO_ID))
    linked = rows.join(by_node.hint("merge"), "node").select("vec_id", "n_links", "component_id", "beam", "recall")
    alone = rows.filter("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("beam"), F.lit(1.0).alias("recall"))
    both = linked.union(alone)
    return both.select(shown(F.col("vec_id")).alias("vec_id"), "n_links", shown(F.col("component_id")).alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"), "beam", "recall")
