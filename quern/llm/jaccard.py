"""Exact Jaccard join of word-shingle sets, by pivots and recursion.

1. Equal sets become one node (128-bit digests; nodes are then numbered).
2. Cells. Sets that link share least(n) or more of a set's n elements. So their first
   n - least(n) + 1 + s hashes have s + 1 in common, s being a fixed part of least(n);
   each is a cell. How many nodes a cell has is counted over all documents, and every node
   leaves its s largest cells: of s + 1 common cells the smallest is never among these.
   What is frequent everywhere thus brings no documents together, and a cell of one node
   none at all.
3. Regions, windows and recursion among the nodes of a cell, as in regions.py, over whole
   texts, from which sets are made anew where they are compared.

No link between different components is lost and none is made up: every link is an exact
comparison.

Defined results: null or wordless texts have an empty set, no link and themselves as
component; a text of fewer words than a shingle has them all as one; rows are told apart
by their sets, so repeated rows share a component, as do rows of one doc_id only if their
sets link; a null doc_id counts as larger than any other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.graph import components
from quern.llm.regions import Rule, connected
from quern.llm.shared import buffer_of, drop_saved, map_batches, mix, saved, word_hashes, word_spans

#: One in so many of the elements that linked sets must share is a spare cell.
SPARE = 8
#: Stands for a null doc_id inside a join: larger than any other.
NO_ID = (1 << 63) - 1

def shingle_sets(column: pa.Array, words: int):
    """For each text its distinct shingle hashes, in order."""
    data, at = buffer_of(column)
    starts, ends, first = word_spans(data, at)
    hashes = word_hashes(data, starts, ends)
    n = len(hashes)
    if n >= words:
        width = n - words + 1
        made = np.zeros(width, np.uint64)
        for k in range(words):
            made = mix(made + hashes[k : k + width] + np.uint64(k + 1))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            yield np.unique(made[a : b - words + 1])
        elif b > a:
            value = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                value = mix(value + h + np.uint64(77))
            yield value
        else:
            yield np.zeros(0, np.uint64)


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def spare(size: int, rule: Rule) -> int:
    """How many of its cells a set of this size leaves."""
    return rule.least(size) // SPARE


def signatures(items: np.ndarray, rule: Rule) -> np.ndarray:
    """The cells of a set, before it leaves its largest ones."""
    size = len(items)
    return items[: size - rule.least(size) + 1 + spare(size, rule)]


def _marks(docs: DataFrame, rule: Rule, cells: bool) -> DataFrame:
    """(doc_id, row, n, digest) of every row, digest null for an empty set; or of those with a digest, with spare and cells."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(batch.column(2), rule.words))
        n, digests = pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())
        if not cells:
            return pa.RecordBatch.from_arrays([*batch.columns[:2], n, digests], ["doc_id", "row", "n", "digest"])
        more = [pa.array([spare(len(s), rule) for s in sets], pa.int32()), pa.array([signatures(s, rule).view(np.int64) for s in sets], pa.list_(pa.int64()))]
        out = pa.RecordBatch.from_arrays([*batch.columns[:2], n, digests, *more], ["doc_id", "row", "n", "digest", "spare", "cells"])
        return out.filter(digests.is_valid())

    return map_batches(docs, step, "doc_id long, row long, n long, digest binary" + (", spare int, cells array<long>" if cells else ""), "text")


def _texts(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(node, payload): the text of each wanted node (node, digest, doc_id, row)."""
    both = docs.join(wanted.hint("merge"), ["doc_id", "row"]).select("node", "digest", "text").dropDuplicates(["node", "text"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = [_digest(s) for s in shingle_sets(batch.column(2), rule.words)]
        keep = pa.array([k for k, want in enumerate(batch.column(1).to_pylist()) if digests[k] == want], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["node", "payload"]).take(keep)

    return map_batches(both, step, "node long, payload string", "text")


def _members(nodes: DataFrame) -> DataFrame:
    """(cell, node) of cells with two nodes or more, without the largest ones that each node leaves; nodes: node, spare, cells."""
    posted = nodes.select("node", "spare", F.explode("cells").alias("cell"))
    many = saved(posted.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "shared-cells")
    met = posted.join(many.hint("merge"), "cell")
    met = saved(met, "postings")
    drop_saved(many)
    # a node's cells are fewer than its words
    largest = Window.partitionBy("node").orderBy(F.desc("n"), "cell")
    return met.withColumn("at", F.row_number().over(largest)).filter("at > spare").select("cell", "node")


class Joined(NamedTuple):
    #: doc_id (NO_ID for null), n and digest of every row; digest is null for an empty set
    rows: DataFrame
    #: node, digest and the smallest doc_id of every set
    nodes: DataFrame
    #: a, b: exact links between nodes that hold every component together
    links: DataFrame


def join(df: DataFrame, rule: Rule = Rule()) -> Joined:  # noqa: B008
    """Links that connect all documents (doc_id, text) whose sets have the rule's similarity."""
    text = F.col("text").cast("string")
    docs = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"))
    rows = saved(_marks(docs, rule, False), "sets")
    first = _marks(docs, rule, True).groupBy("digest").agg(F.min(F.struct("doc_id", "row", "spare", "cells")).alias("at"))
    nodes = saved(first.select(F.monotonically_increasing_id().alias("node"), "digest", "at.doc_id", "at.row", "at.spare", "at.cells"), "nodes")
    members = saved(_members(nodes), "members")
    named = nodes.select("node", "digest", "doc_id", "row")
    held = saved(_texts(docs, named.join(members.select("node").distinct().hint("merge"), "node"), rule), "texts")
    sets_of = lambda column: list(shingle_sets(column, rule.words))
    links = connected(members, held, sets_of, rule)
    return Joined(rows.select("doc_id", "n", "digest"), nodes.select("node", "digest", "doc_id"), links)


def classes(df: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles and component_id of every row."""
    rows, nodes, links = join(df, rule)
    roots = components(links)
    rooted = saved(nodes.join(roots.hint("merge"), "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root")), "rooted")
    least = saved(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    by_set = saved(rooted.join(least.hint("merge"), "root").select("digest", "component_id"), "by-set")
    shown = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    linked = rows.join(by_set.hint("merge"), "digest").select(shown("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component_id").alias("component_id"))
    alone = rows.filter("digest IS NULL").select(shown("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("doc_id").alias("component_id"))
    return linked.union(alone)


def one_of_each(df: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """df without the documents that aren't the smallest doc_id of their component; rows without a doc_id or of one doc_id stay."""
    keys = [F.col("doc_id")]
    gone = classes(df, rule).filter("doc_id <> component_id").select(*keys).distinct()
    return df.join(gone.hint("merge"), "doc_id", "left_anti").select(*df.columns)
