"""Substring dedup: paragraphs, MinHash bands, exact checks and components.

Paragraphs are lines of LINE words or more, and segments, which cover the text whatever
its line breaks: they are cut where a five-word hash is the smallest within REACH
positions on both sides, so cuts depend on the words around them alone; short ones for
short passages and, again over the whole text, long ones that bear more edits. A segment
of fewer than LINE words is none. A paragraph's node is the hash of its words: exact repeats
are one node, however many documents hold them.

1. Occurrences of paragraphs and seeds: document, position, node. A seed is SEED words
   whose first five-word hash is the smallest of some window of SAMPLE positions; every
   run of UNIT words holds one whole, and equal runs hold equal ones.
2. Near repeats: BANDS bands of ROWS minima of a paragraph's five-word shingles; a pair of
   Jaccard LEAST or more collides in some band with probability recall(); lines,
   short and long segments each among themselves. Equal rows of a slice go out once, and only bands where
   different nodes meet are kept.
3. What collides is checked exactly (Jaccard of the five-word shingles LEAST or more) by
   the pivots, windows and blocks of regions.py, which lists no pairs.
4. Checked pairs are joined into components. In each, the document of the smallest doc_id
   keeps its occurrences; those of every other document are removed: of linked lines all
   words, of others those from the first to the last shingle that linked paragraphs share
   (extents()).
5. Exact repeats go to their real ends: a document that shares a seed with an earlier one
   streams past the text of the earliest, and what both hold around the seed, word by
   word, is removed (repeats()). So no run of UNIT words that an earlier document holds
   stays whole.
6. Removed stretches that overlap or touch are removed as one span of words.

Defined results: null texts and texts of fewer than LINE words have no paragraph; repeats
within one document stay; equal rows are treated alike; rows of one doc_id with different
texts are told apart by the text's hash, and count as one document; a null doc_id counts
as larger than any other; a seed that the earlier text holds several times is compared at
its first place. Extra columns are ignored or, in deduplicated(), kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.graph import components
from quern.llm.regions import Rule, connected, stored_sets
from quern.llm.shared import SLICE_BYTES, buffer_of, drop_saved, map_batches, mix, powers, saved, slices, word_hashes, word_spans

LINE = 24
UNIT = 40
SEED = 24
SAMPLE = UNIT - SEED + 1
REACH = (24, 72)
SHINGLE = 5
BANDS, ROWS = 9, 4
#: Bands that are dealt in one shuffle, which bounds the disk that they take.
AT_ONCE = 3
LEAST = 0.8
RULE = Rule(words=SHINGLE, percent=round(100 * LEAST))
#: Documents that stream past one copy of an earlier text.
SPREAD = 512
NO_ID = (1 << 63) - 1
BAND = [f"b{k}" for k in range(BANDS)]
_TURNS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that a pair of that similarity meets in a band."""
    return 1 - (1 - similarity**rows) ** bands


def tuned(similarity: float = LEAST, least: float = 0.99, rows: int = ROWS) -> int:
    """The fewest bands of that many rows whose recall is high enough."""
    bands = 1
    while recall(similarity, bands, rows) < least:
        bands += 1
    return bands


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes."""
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: len(hashes) - width + 1])


class Units:
    """The paragraphs and seeds of the texts of one column, all as word positions of the texts end to end."""

    def __init__(self, column: pa.Array):
        data, offsets = buffer_of(column)
        starts, ends, self.first = word_spans(data, offsets)
        self.hashes = word_hashes(data, starts, ends)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        n = len(self.hashes)
        self.grams = _runs(self.hashes, SHINGLE) if n >= SHINGLE else self.hashes[:0]
        # a line begins at a text's first word and at each word with a line feed between it and the one before
        feeds = np.concatenate([[0], np.cumsum(data == 0x0A)])
        self.breaks = np.flatnonzero(np.r_[True, (self.text[1:] != self.text[:-1]) | (feeds[starts[1:]] > feeds[ends[:-1]])]) if n else np.zeros(0, np.int64)

    def _whole(self, where: np.ndarray, width: int) -> np.ndarray:
        """The positions whose ``width`` words end within their text."""
        where = where[where <= len(self.text) - width]
        return where[self.text[where] == self.text[where + width - 1]]

    def _least(self, window: int) -> np.ndarray:
        """The smallest five-word hash of each window of positions; 0 for windows that run over a text's end."""
        width, n = window + SHINGLE - 1, len(self.text)
        if n < width:
            return np.zeros(0, np.uint64)
        return np.where(self.text[: n - width + 1] == self.text[width - 1 :], _sliding(self.grams, window, np.minimum), np.uint64(0))

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and nodes of the seeds, in order; of a stretch of equal neighbours the last and every SAMPLE-th."""
        least = self._least(SAMPLE)
        if not len(least):
            return np.zeros(0, np.int64), self.hashes[:0]
        pad = np.zeros(SAMPLE - 1, np.uint64)
        chosen = _sliding(np.concatenate([pad, least, pad]), SAMPLE, np.maximum) == self.grams
        # neighbours of one text only, so that seeds don't depend on the texts before and after
        same = np.r_[False, (self.grams[1:] == self.grams[:-1]) & (self.text[: -SHINGLE] == self.text[SHINGLE:])]
        where = np.arange(len(same))
        offset = where - np.maximum.accumulate(np.where(same, 0, where))
        chosen &= np.r_[~same[1:], True] | (offset % SAMPLE == 0)
        at = self._whole(np.flatnonzero(chosen), SEED)
        return at, _runs(self.hashes, SEED)[at] if len(at) else self.hashes[:0]

    def _segments(self, reach: int) -> tuple[np.ndarray, np.ndarray]:
        least = self._least(2 * reach + 1)
        middle = self.grams[reach : reach + len(least)]
        # only the first of equal neighbours cuts
        cuts = reach + np.flatnonzero((least == middle) & (self.grams[reach - 1 : reach - 1 + len(least)] != middle))
        begin = np.union1d(cuts, np.flatnonzero(np.r_[True, self.text[1:] != self.text[:-1]]))
        return begin, np.diff(np.r_[begin, len(self.text)])

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, size and node of each: lines, whose nodes end in the bits 00, then short and long segments, whose nodes end in 01 and 11."""
        n = len(self.hashes)
        if n < LINE:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), self.hashes[:0]
        kinds = [(self.breaks, np.diff(np.r_[self.breaks, n])), *map(self._segments, REACH)]
        kinds = [(at[size >= LINE], size[size >= LINE]) for at, size in kinds]
        at, size = (np.concatenate(x) for x in zip(*kinds, strict=True))
        up, down = powers(n + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * up[:n])])
        node = mix((total[at + size] - total[at]) * down[at] ^ mix(size.astype(np.uint64)))
        kind = np.repeat(np.array([0, 1, 3], np.uint64), [len(x[0]) for x in kinds])
        return at, size, node & ~np.uint64(3) | kind

    def bands(self, at: np.ndarray, size: np.ndarray, node: np.ndarray, asked: range = range(BANDS)) -> np.ndarray:
        """One hash per paragraph and asked band."""
        if not len(at):
            return np.zeros((0, len(asked)), np.uint64)
        cuts = np.stack([at, at + size - SHINGLE + 1], axis=1).ravel()
        padded = np.append(self.grams, self.grams[-1:])
        out = []
        for band in asked:
            value = (node & np.uint64(3)) * np.uint64(BANDS) + np.uint64(band + 1)
            for turn in _TURNS[band * ROWS : (band + 1) * ROWS]:
                value = mix(value + np.minimum.reduceat(padded * turn + (turn >> np.uint64(7)), cuts)[::2])
            out.append(value)
        return np.stack(out, axis=1)


def _row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _docs(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), _row_hash(F.col("text")).alias("row"), F.col("text").cast("string").alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, start, words, node, seed, b0, ...) of every paragraph and seed; of equal paragraphs of a slice the first has its bands."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = Units(batch.column(2))
        at, size, node = units.paragraphs()
        seed_at, seed = units.seeds()
        place = np.r_[at, seed_at]
        text = units.text[place]
        start, words = place - units.first[text], np.r_[size, np.full(len(seed_at), SEED)]
        of = pa.array(text)
        columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(start.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(np.r_[node, seed].view(np.int64)), pa.array(np.arange(len(place)) >= len(at))]
        first = np.sort(np.unique(node, return_index=True)[1])  # in the text's order, so that minima are taken over short stretches
        none = np.ones(len(place), bool)
        none[first] = False
        for band in units.bands(at[first], size[first], node[first]).T:
            value = np.zeros(len(place), np.uint64)  # one each: the column keeps it
            value[first] = band
            columns.append(pa.array(value.view(np.int64), mask=none))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "start", "words", "node", "seed", *BAND])

    return map_batches(docs, step, f"doc_id long, row long, start int, words int, node long, seed boolean, {', '.join(f'{b} long' for b in BAND)}", "text")


def collisions(found: DataFrame, asked: range = range(BANDS)) -> DataFrame:
    """(cell, node): the asked bands that two different paragraphs or more collide in, and all of theirs."""

    def shared(batches):
        # rows come by band and node; a band's first row goes out once a second node follows
        last = None  # band, node, whether it has gone out
        for batch in batches:
            bands, nodes = (batch.column(k).to_numpy() for k in range(2))
            if not len(bands):
                continue
            if last is not None:
                bands, nodes = np.r_[last[0], bands], np.r_[last[1], nodes]
            follows = np.r_[False, bands[1:] == bands[:-1]]
            fresh = ~(follows & np.r_[False, nodes[1:] == nodes[:-1]])
            run = np.cumsum(~follows) - 1
            many = np.bincount(run, fresh) > 1
            if last is not None and last[2]:
                many[0] = True
            gone = last is not None and last[2]
            out = np.flatnonzero(many[run] & fresh)
            if gone:
                out = out[out > 0]
            last = bands[-1], nodes[-1], bool(many[run[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(bands[out]), pa.array(nodes[out])], ["cell", "node"])

    cells = F.explode(F.array(*[F.col(BAND[k]) for k in asked])).alias("cell")
    rows = found.filter(F.col(BAND[0]).isNotNull()).select(cells, "node")
    return rows.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(shared, "cell long, node long")


def contents(docs: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, payload): the five-word shingles of each wanted paragraph, in order."""
    place = found.join(wanted.hint("merge"), "node").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("at"))
    by_text = place.groupBy("at.doc_id", "at.row").agg(F.collect_list("node").alias("nodes"))
    # equal rows go here, where they already meet, and not once their shingles are made
    texts = docs.join(by_text.hint("merge"), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("text", "nodes")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = Units(batch.column(0))
        at, size, node = units.paragraphs()
        asked = [set(x) for x in batch.column(1).to_pylist()]
        all_of = zip(units.text[at].tolist(), node.view(np.int64).tolist(), strict=True)
        held = {one: k for k, (text, one) in enumerate(all_of) if one in asked[text]}
        payload = [units.grams[at[k] : at[k] + size[k] - SHINGLE + 1].tobytes() for k in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(payload, pa.binary())], ["node", "payload"])

    return map_batches(texts, step, "node long, payload binary", "text")


def extents(near: DataFrame, held: DataFrame) -> DataFrame:
    """(node, skip, last): the words of a linked paragraph that a link takes: all between lines, else from the first shared shingle to the last."""
    both = near.filter("a <> b").union(near.filter("a <> b").select("b", "a")).distinct()
    own, other = held.select(F.col("node").alias("a"), F.col("payload").alias("mine")), held.select(F.col("node").alias("b"), F.col("payload").alias("theirs"))
    part = both.filter("(a & 1) + (b & 1) > 0")
    pairs = part.join(own.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "mine", "theirs")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, last = [], []
        for mine, theirs in zip(batch.column(1), batch.column(2), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (mine, theirs))
            same = np.flatnonzero(np.isin(x, y))
            first.append(int(same[0]))
            last.append(int(same[-1]) + SHINGLE)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["node", "skip", "last"])

    cut = map_batches(pairs, step, "node long, skip int, last int")
    whole = both.filter("(a & 1) + (b & 1) = 0").select(F.col("a").alias("node"), F.lit(0).alias("skip"), F.lit((1 << 31) - 1).alias("last"))
    return cut.union(whole).groupBy("node").agg(F.min("skip").alias("skip"), F.max("last").alias("last"))


def common_runs(own: np.ndarray, at: np.ndarray, nodes: np.ndarray, other: np.ndarray, first_at: np.ndarray, first_nodes: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the stretches of ``own`` words around its seeds on which ``other`` agrees; first_nodes: other's seeds in order, with their first places."""
    out: list[tuple[int, int]] = []
    if not len(first_nodes):
        return out
    k = np.minimum(np.searchsorted(first_nodes, nodes), len(first_nodes) - 1)
    shift, upto = None, 0
    for i, j in zip(at[first_nodes[k] == nodes].tolist(), first_at[k[first_nodes[k] == nodes]].tolist(), strict=True):
        if i - j == shift and i < upto or not (own[i : i + SEED] == other[j : j + SEED]).all():
            continue
        back, ahead = min(i, j), min(len(own) - i, len(other) - j)
        unlike = np.flatnonzero(own[i - back : i] != other[j - back : j])
        begin = i - back + (int(unlike[-1]) + 1 if len(unlike) else 0)
        unlike = np.flatnonzero(own[i : i + ahead] != other[j : j + ahead])
        shift, upto = i - j, i + (int(unlike[0]) if len(unlike) else ahead)
        out.append((begin, upto))
    return out


def repeats(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, row, runs, keep): one row for each pair, with the stretches that the text shares, around a seed, with the earlier one; pairs: doc_id, row, keep, keep_row, distinct."""
    sizes = saved(pairs.groupBy("keep", "keep_row").agg(F.count("*").alias("n")), "keepers")
    parts = F.ceil(F.col("n") / F.lit(SPREAD)).cast("int")
    members = pairs.join(sizes.hint("merge"), ["keep", "keep_row"]).select("doc_id", "row", "keep", "keep_row", F.pmod(F.xxhash64("doc_id", "row"), parts).cast("int").alias("part"), F.lit(True).alias("member"))
    own = sizes.select(F.col("keep").alias("doc_id"), F.col("keep_row").alias("row"), "keep", "keep_row", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(False).alias("member"))
    sent = docs.join(members.union(own).hint("merge"), ["doc_id", "row"]).select("doc_id", "row", "keep", "keep_row", "part", "member", "text")
    names = ["doc_id", "row", "runs", "keep"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier = None  # words, first places and nodes of the text that the next ones are held against
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                units = Units(part.column(6))
                at, node = units.seeds()
                cuts = np.searchsorted(at, units.first)
                of, runs = [], []
                for k, member in enumerate(part.column(5).to_pylist()):
                    words = units.hashes[units.first[k] : units.first[k + 1]]
                    places, nodes = at[cuts[k] : cuts[k + 1]] - units.first[k], node[cuts[k] : cuts[k + 1]]
                    if member:
                        got = common_runs(words, places, nodes, *earlier)
                        if got:
                            of.append(k)
                            runs.append([{"start": begin, "words": end - begin} for begin, end in got])
                    else:
                        distinct, first = np.unique(nodes, return_index=True)
                        earlier = words.copy(), places[first], distinct
                rows = part.select(["doc_id", "row", "keep"]).take(pa.array(of, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(runs, kind), rows.column(2)], names)

    ordered = sent.repartition("keep", "keep_row", "part").sortWithinPartitions("keep", "keep_row", "part", "member")
    return ordered.mapInArrow(run, "doc_id long, row long, runs array<struct<start:int,words:int>>, keep long")


def removals(df: DataFrame) -> DataFrame:
    """(doc_id, row, spans): for each text that loses words, the spans (words first to last - 1) and the documents that keep them."""
    docs = _docs(df)
    found = saved(occurrences(docs), "paragraphs")
    # exact repeats: the smallest document of each seed, and of its rows the smallest
    seeds = found.filter("seed").select("doc_id", "row", "node")
    # sums are saved before they are joined: Spark splits a frequent seed's rows only where a join reads both sides from a shuffle
    span = saved(seeds.groupBy("node").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("hi")).filter("keep < hi").drop("hi"), "seed-spans")
    hits = saved(seeds.join(span.hint("merge"), "node"), "repeated-seeds")
    first = saved(hits.filter("doc_id = keep").groupBy("node").agg(F.min("row").alias("keep_row")), "seed-keepers")
    pairs = hits.filter("doc_id > keep").join(first.hint("merge"), "node").select("doc_id", "row", "keep", "keep_row").distinct()
    pairs = saved(pairs, "repeating-texts")
    for done in (span, hits, first):
        drop_saved(done)
    rounds = [saved(collisions(found, range(k, min(k + AT_ONCE, BANDS))), "paragraph-bands") for k in range(0, BANDS, AT_ONCE)]
    whole, found = found, saved(found.filter("NOT seed").drop("seed", *BAND), "paragraph-places")
    drop_saved(whole)
    exact = saved(repeats(docs, pairs), "paragraph-repeats")
    # near repeats
    cells = reduce(DataFrame.union, rounds)
    held = saved(contents(docs, found, cells.select("node").distinct()), "paragraph-contents")
    near = saved(connected(cells, held, stored_sets, RULE), "paragraph-near")
    for done in rounds:
        drop_saved(done)
    roots = components(near)
    seen = found.groupBy("node").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    rooted = seen.join(roots.hint("merge"), "node", "left").filter("lo < hi OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    rooted = saved(rooted, "paragraph-nodes")
    kept = saved(rooted.groupBy("root").agg(F.min("lo").alias("keep"), F.max("hi").alias("hi")).filter("keep < hi").select("root", "keep"), "paragraph-keepers")
    taken = saved(extents(near, held), "paragraph-extents")
    by_node = saved(rooted.join(kept.hint("merge"), "root").join(taken.hint("merge"), "node", "left").select("node", "keep", "skip", "last"), "paragraph-removed")
    for done in (held, near, rooted, kept, taken):
        drop_saved(done)
    size = F.least("words", F.coalesce("last", "words")) - F.coalesce("skip", F.lit(0))
    gone = found.join(by_node.hint("merge"), "node").filter("doc_id > keep")
    run = F.struct((F.col("start") + F.coalesce("skip", F.lit(0))).alias("start"), size.alias("words"))
    gone = gone.select("doc_id", "row", F.array(run).alias("runs"), "keep").union(exact)
    grouped = gone.groupBy("doc_id", "row").agg(F.collect_set(F.struct("runs", "keep")).alias("units"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for units in batch.column(2).to_pylist():
            spans: list[dict] = []
            for start, words, keep in sorted((r["start"], r["words"], unit["keep"]) for unit in units for r in unit["runs"]):
                if spans and start <= spans[-1]["last"]:
                    spans[-1]["last"] = max(start + words, spans[-1]["last"])
                    spans[-1]["kept"].add(keep)
                else:
                    spans.append({"first": start, "last": start + words, "kept": {keep}})
            out.append([s | {"kept": sorted(s["kept"])} for s in spans])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kept", pa.list_(pa.int64()))]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc_id", "row", "spans"])

    return map_batches(grouped, step, "doc_id long, row long, spans array<struct<first:int,last:int,kept:array<long>>>")


def removed_spans(df: DataFrame) -> DataFrame:
    """One row for each removed span: doc_id, first_word, last_word (exclusive), kept_doc_ids."""
    spans = removals(df).select("doc_id", F.explode("spans").alias("s"))
    return spans.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.col("s.first").cast("long").alias("first_word"),
        F.col("s.last").cast("long").alias("last_word"),
        F.array_join(F.transform("s.kept", lambda k: k.cast("string")), ",").alias("kept_doc_ids"),
    )


def deduplicated(df: DataFrame) -> DataFrame:
    """df without the removed spans; texts that lose all their words go. n_chars, if there, is set anew."""
    names = df.columns
    cut = removals(df).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "spans")
    keyed = df.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_row": _row_hash(F.col("text"))})
    both = keyed.join(cut.hint("merge"), ["_doc", "_row"], "left").select(*names, "spans")
    at = names.index("text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffer_of(batch.column(at))
        starts, ends, first = word_spans(data, offsets)
        texts, keep = batch.column(at).to_pylist(), []
        for k, spans in enumerate(batch.column(len(names)).to_pylist()):
            if spans:
                words, begin = first[k + 1] - first[k], offsets[k]
                parts = []
                for span in spans:
                    parts.append(data[begin : starts[first[k] + span["first"]]].tobytes())
                    begin = starts[first[k] + span["last"]] if span["last"] < words else offsets[k + 1]
                texts[k] = (b"".join(parts) + data[begin : offsets[k + 1]].tobytes()).decode()
                if not texts[k].strip(" \t\n\x0b\x0c\r"):
                    continue
            keep.append(k)
        columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names).take(pa.array(keep, pa.int32()))

    out = map_batches(both, step, ", ".join(f"`{n}` {t}" for n, t in df.dtypes), "text")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
