"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from mapped files.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token; a
start context stands before the first. Words are known by 64-bit hashes. Counting takes
two passes: words, then pairs of the words' ranks in the sorted hash array. In each pass
a task sums what it has read and deals it, by hash, to shards; each shard is merged into
one sorted hash array with counts and written to the shared folder, where workers map it.
Pair hashes are a bijection of the two ranks, so pairs never collide, and a pair's words
can be had back from its hash. Nothing that grows with the corpus passes the driver: it
sees a few numbers per shard. The number of shards follows the bytes of the input.

Probability of w after v, with D the discounts by count:
  p(w | v) = (c(vw) - D(c(vw))) / c(v) + g(v) p(w),  g(v) = sum of D over v's pairs / c(v)
  p(w) = (n(w) - D'(n(w))) / T + g' / (V + 1),       n(w): distinct words before w, T: pairs
and p(w | v) = p(w) where v was never seen; an unknown word has n = 0.

Defined results: a null or blank text is its end token alone; a null doc_id counts as an
empty string in the fold; repeated rows count and are scored each. Without training
tokens every score is 0 (one class of unknown words has all the probability). Discounts
fall back to 0.5, 1 and 1.5 where counts of counts don't give a value in range. A
vocabulary of 2**32 words or more is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import SLICE_BYTES, buffer_of, map_batches, mapped, mix, put, saved, shared_dir, slices, word_hashes, word_spans

FOLDS, HELD_OUT = 10, 0
#: Bytes of text to a shard, and entries that a task sums up before it deals them out.
SHARD_BYTES = 32 << 20
TASK_ENTRIES = 3 << 20
END = np.uint64(0x5D1CE0F4A1B2C3D7)
ADDED = 0.1


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of shared.mix()."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards in the hashes' own order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


class Table:
    """A sorted hash array in shards, and columns beside it."""

    def __init__(self, folder: str, kind: str, sizes: tuple, columns: dict[str, str]):
        self.keys = [mapped(folder, f"{kind}{k}.hash", "<u8") for k in range(len(sizes))]
        self.columns = {name: [mapped(folder, f"{kind}{k}.{name}", dtype.get(k, "<u4") if isinstance(dtype, dict) else dtype) for k in range(len(sizes))] for name, dtype in columns.items()}
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def find(self, sorted_hashes: np.ndarray, *names: str) -> tuple[np.ndarray, ...]:
        """Ranks of hashes that come in order (-1: absent), and the named columns' values (0: absent)."""
        n = len(sorted_hashes)
        rank = np.full(n, -1, np.int64)
        values = [np.zeros(n, np.result_type(*self.columns[name])) for name in names]
        cuts = np.searchsorted(shard_of(sorted_hashes, len(self.keys)), np.arange(len(self.keys) + 1, dtype=np.uint64))
        for k, keys in enumerate(self.keys):
            a, b = cuts[k], cuts[k + 1]
            if a == b or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, sorted_hashes[a:b]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == sorted_hashes[a:b])
            rank[a + hit] = self.base[k] + at[hit]
            for name, out in zip(names, values, strict=True):
                out[a + hit] = self.columns[name][k][at[hit]]
        return rank, *values


# Counting


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts end to end, and where each text's tokens begin (one more entry: all)."""
    data, at = buffer_of(column)
    starts, ends, first = word_spans(data, at)
    texts = len(at) - 1
    first = first + np.arange(texts + 1)
    tokens = np.empty(len(starts) + texts, np.uint64)
    last = first[1:] - 1
    own = np.ones(len(tokens), bool)
    own[last] = False
    tokens[own] = word_hashes(data, starts, ends)
    tokens[last] = END
    return tokens, first


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _counted(df: DataFrame, shards: int, keys_of: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(shard, keys, counts): what each task has counted of its texts, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[k], cuts[k + 1])
                row = [pa.array([int(k)], pa.int32()), pa.array([keys[part].tobytes()], pa.binary()), pa.array([counts[part].astype("<u8").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["shard", "keys", "counts"])

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                held.append(summed(keys_of(part.column(0))))
                if sum(len(k) for k, _ in held) > TASK_ENTRIES:
                    yield from out()
        if held:
            yield from out()

    return df.select("text").mapInArrow(run, "shard int, keys binary, counts binary")


def _by_shard(df: DataFrame, shards: int, merge: Callable[[int, list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """merge(shard, rows) for the rows of each shard, in the task that the shard is dealt to."""
    names = df.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(names) + 1)), strict=True):
                if row[0] != now:
                    if rows:
                        yield from merge(now, rows)
                    now, rows = row[0], []
                rows.append(row[1:])
        if rows:
            yield from merge(now, rows)

    return df.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard").mapInArrow(run, schema)


def _row(*values) -> pa.RecordBatch:
    arrays = [pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values]
    return pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(values))])


def _merged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(r[0], "<u8") for r in rows])
    counts = np.concatenate([np.frombuffer(r[1], "<u8") for r in rows]).astype(np.int64)
    return summed(keys, counts)


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), "<u4")


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3 from how many counts are 1, 2, 3 and 4."""
    if all(n[:4]):
        y = n[0] / (n[0] + 2 * n[1])
        found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
        if all(0 < d <= k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


class Model(NamedTuple):
    folder: str
    word_sizes: tuple
    pair_sizes: tuple
    #: Shards of pairs whose counts need 64 bits.
    wide: tuple
    tokens: int
    texts: int
    words: int
    pairs: int
    pair_discounts: tuple
    word_discounts: tuple
    #: Probability that the unigrams leave to all V + 1 classes alike.
    left: float


WORD_COLUMNS = {"count": "<i8", "before": "<u4", "left": "<f8"}


@lru_cache(maxsize=1)
def _words(folder: str, sizes: tuple, whole: bool) -> Table:
    return Table(folder, "w", sizes, WORD_COLUMNS if whole else {})


@lru_cache(maxsize=1)
def _pairs(folder: str, sizes: tuple, wide: tuple) -> Table:
    return Table(folder, "p", sizes, {"count": dict.fromkeys(wide, "<u8")})


def _ranks(tokens: np.ndarray, words: Table, *names: str) -> list[np.ndarray]:
    distinct, at = np.unique(tokens, return_inverse=True)
    return [x[at] for x in words.find(distinct, *names)]


def _contexts(rank: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The rank before each token; ``start`` before a text's first."""
    before = np.empty_like(rank)
    before[1:] = rank[:-1]
    before[first[:-1]] = start
    return before


def pair_hash(before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return mix(before.astype(np.uint64) << np.uint64(32) | rank.astype(np.uint64))


def fit(df: DataFrame, folder: str | None = None) -> Model:
    """Counts the texts of df and writes the model to the shared folder."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark, "ngram")
    texts, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(8, -(-size // SHARD_BYTES))

    def write_words(shard: int, rows: list) -> Iterator[pa.RecordBatch]:
        keys, counts = _merged(rows)
        put(folder, f"w{shard}.hash", keys)
        put(folder, f"w{shard}.count", counts)
        yield _row(shard, len(keys), int(counts.sum()))

    found = _by_shard(_counted(df, shards, lambda column: tokens_of(column)[0]), shards, write_words, "shard long, n long, total long").collect()
    sizes = {r.shard: r.n for r in found}
    for k in set(range(shards)) - sizes.keys():
        put(folder, f"w{k}.hash", np.zeros(0, np.uint64))
        put(folder, f"w{k}.count", np.zeros(0, np.int64))
    word_sizes = tuple(sizes.get(k, 0) for k in range(shards))
    words, tokens = sum(word_sizes), sum(r.total for r in found)
    if words >= 1 << 32:
        raise ValueError("the vocabulary has 2**32 words or more")
    base = np.concatenate([[0], np.cumsum(word_sizes)]).astype(np.int64)
    base[-1] += 1  # the start context comes last, with rank ``words``

    def pairs_of(column: pa.Array) -> np.ndarray:
        hashes, first = tokens_of(column)
        (rank,) = _ranks(hashes, _words(folder, word_sizes, False))
        return pair_hash(_contexts(rank, first, words), rank)

    def write_pairs(shard: int, rows: list) -> Iterator[pa.RecordBatch]:
        keys, counts = _merged(rows)
        put(folder, f"p{shard}.hash", keys)
        large = bool(len(counts) and counts.max() >= 1 << 32)
        put(folder, f"p{shard}.count", counts.astype("<u8" if large else "<u4"))
        pair = unmix(keys)
        before, after = pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)
        tally = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        # by context: pairs seen once, twice, more often; by word: contexts
        by = [summed(before[counts == 1]), summed(before[counts == 2]), summed(before[counts > 2]), summed(after)]
        cuts = [np.searchsorted(ranks.astype(np.int64), base) for ranks, _ in by]
        for k in range(shards):
            parts = [(ranks[c[k] : c[k + 1]].astype(np.int64) - base[k], n[c[k] : c[k + 1]]) for (ranks, n), c in zip(by, cuts, strict=True)]
            packed = [x for ranks, n in parts for x in (len(ranks), _pack(np.diff(ranks, prepend=0)), _pack(n))]
            yield _row(k, *packed, *(tally if k == 0 else [0] * 4), shard if k == 0 else -1, len(keys) if k == 0 else 0, int(large and k == 0))

    fields = ", ".join(f"n{k} long, ranks{k} binary, counts{k} binary" for k in range(4))
    schema = f"shard long, {fields}, t1 long, t2 long, t3 long, t4 long, pairs_shard long, pairs long, large long"
    partial = saved(_by_shard(_counted(df, shards, pairs_of), shards, write_pairs, schema), "ngram-partial")
    heads = partial.filter("pairs_shard >= 0").select("t1", "t2", "t3", "t4", "pairs_shard", "pairs", "large").collect()
    sizes = {r.pairs_shard: r.pairs for r in heads}
    for k in set(range(shards)) - sizes.keys():
        put(folder, f"p{k}.hash", np.zeros(0, np.uint64))
        put(folder, f"p{k}.count", np.zeros(0, np.uint32))
    pair_sizes = tuple(sizes.get(k, 0) for k in range(shards))
    wide = tuple(r.pairs_shard for r in heads if r.large)
    pair_discounts = discounts([sum(r[k] for r in heads) for k in range(4)])

    def write_contexts(shard: int, rows: list) -> Iterator[pa.RecordBatch]:
        width = int(base[shard + 1] - base[shard])
        seen = [np.zeros(width, np.int64) for _ in range(4)]
        for row in rows:
            for k in range(4):
                n = row[3 * k]
                np.add.at(seen[k], np.cumsum(_unpack(row[3 * k + 1], n).astype(np.int64)), _unpack(row[3 * k + 2], n))
        count = np.array(mapped(folder, f"w{shard}.count", "<i8"), np.float64)
        if shard == shards - 1:
            count = np.append(count, texts)
        mass = sum(d * s for d, s in zip(pair_discounts, seen[:3], strict=True))
        left = np.divide(mass, count, out=np.ones(width), where=count > 0)
        put(folder, f"w{shard}.left", left)
        put(folder, f"w{shard}.before", seen[3].astype("<u4"))
        yield _row(shard, *(int((seen[3] == k).sum()) for k in (1, 2, 3, 4)), int((seen[3] > 2).sum()))

    columns = ["shard", *(x for k in range(4) for x in (f"n{k}", f"ranks{k}", f"counts{k}"))]
    tallies = _by_shard(partial.select(*columns), shards, write_contexts, "shard long, t1 long, t2 long, t3 long, t4 long, more long").collect()
    for k in set(range(shards)) - {r.shard for r in tallies}:
        width = int(base[k + 1] - base[k])
        put(folder, f"w{k}.left", np.ones(width))
        put(folder, f"w{k}.before", np.zeros(width, "<u4"))
    total = [sum(r[k] for r in tallies) for k in range(1, 6)]
    word_discounts = discounts(total)
    pairs = sum(pair_sizes)
    left = (word_discounts[0] * total[0] + word_discounts[1] * total[1] + word_discounts[2] * total[4]) / pairs if pairs else 1.0
    return Model(folder, word_sizes, pair_sizes, wide, tokens, texts, words, pairs, pair_discounts, word_discounts, left)


# Scoring


def _discounted(count: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0.0)


def log_chances(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens: log10 p, log10 of the base estimate, whether known; and where each text's tokens begin."""
    hashes, first = tokens_of(column)
    table = _words(model.folder, model.word_sizes, True)
    rank, count, seen_before, left = _ranks(hashes, table, "count", "before", "left")
    known = rank >= 0
    base = np.log10((count + ADDED) / (model.tokens + ADDED * (model.words + 1)))
    chance = np.full(len(rank), model.left / (model.words + 1))
    if model.pairs:
        chance += _discounted(seen_before.astype(np.int64), model.word_discounts) / model.pairs
        before = _contexts(rank, first, model.words)
        context_count = _contexts(np.where(known, count, 0), first, model.texts).astype(np.float64)
        context_left = np.empty(len(rank))
        context_left[1:] = left[:-1]
        context_left[first[:-1]] = table.columns["left"][-1][-1]
        pair_count = np.zeros(len(rank), np.int64)
        both = np.flatnonzero(known & (before >= 0))
        distinct, at = np.unique(pair_hash(before[both], rank[both]), return_inverse=True)
        pair_count[both] = _pairs(model.folder, model.pair_sizes, model.wide).find(distinct, "count")[1][at]
        met = context_count > 0
        higher = _discounted(pair_count, model.pair_discounts) / np.where(met, context_count, 1) + context_left * chance
        chance = np.where(met, higher, chance)
    return np.log10(chance), base, known, first


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score, perplexity) of every text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        chance, base, known, first = log_chances(batch.column(1), model)
        n, at = np.diff(first), first[:-1]
        sums = [np.add.reduceat(x, at) for x in (known.astype(np.int64), base, chance)]
        columns = [n, *sums, 10 ** (-sums[2] / n)]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["key", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double"
    return map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), step, schema, "text").withColumnRenamed("key", key)


def score_documents(df: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32(doc_id as text) mod FOLDS isn't HELD_OUT and scores all."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    model = fit(df.filter(~held_out).select("text"))
    keyed = df.select(F.struct("doc_id", held_out.alias("held_out")).alias("key"), "text")
    got = score(keyed, model, key="key")
    return got.select("key.doc_id", "key.held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
