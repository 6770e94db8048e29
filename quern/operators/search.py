"""Retrieval operators: vector search, BM25 with field bands, rank fusion and graph boost.

Every ranking filters before it cuts (a filter on a chunk table reaches the scan), rounds
scores before ordering, breaks ties by id, and ends in a bounded top-k.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"
K1, B = 1.2, 0.75
MAX_LIMIT = 100
DIGITS = 6


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError("limit must be 1 to 100")
    return limit


def check_vector(vector: list[float], cosine: bool) -> list[float]:
    if not vector or not all(math.isfinite(x) for x in vector):
        raise ValueError("query vector must be finite and not empty")
    if cosine and not any(vector):
        raise ValueError("a zero vector has no direction")
    return vector


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def nearest(vectors: DataFrame, query: list[float], limit: int, metric: str = "cosine") -> DataFrame:
    """(chunk_id, score) of the nearest vectors: score is minus the distance, ties by id. An empty table gives none."""
    check_limit(limit)
    q = F.array(*[F.lit(float(x)) for x in check_vector(query, metric == "cosine")])
    v = F.col("vector")
    distance = 1.0 - cosine_similarity(v, q) if metric == "cosine" else l2_distance(v, q)
    fits = vectors.filter((F.size("vector") == len(query)) & (dot(v, v) > 0 if metric == "cosine" else F.lit(True)))
    scored = fits.select("chunk_id", (F.round(-distance, DIGITS) + F.lit(0.0)).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(limit)


def _blocks(vectors: DataFrame, size: int, cosine: bool, prefix: str) -> DataFrame:
    """Vectors of one length as packed blocks: {prefix}_ids, {prefix}_values, width."""
    v = F.col("vector")
    fits = vectors.filter((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()) & (dot(v, v) > 0 if cosine else F.lit(True)))

    def step(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            widths = np.array([len(r) for r in rows])
            for width in np.unique(widths).tolist():
                where = np.flatnonzero(widths == width)
                for at in range(0, len(where), size):
                    part = where[at : at + size]
                    flat = np.array([rows[k] for k in part], np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[part].astype("<i8").tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary()), pa.array([width], pa.int32())], [f"{prefix}_ids", f"{prefix}_values", "width"])

    return fits.select(F.col("chunk_id").cast("long"), v).mapInArrow(step, f"{prefix}_ids binary, {prefix}_values binary, width int")


def _best(q: np.ndarray, v: np.ndarray, qid: np.ndarray, vid: np.ndarray, limit: int, cosine: bool) -> tuple:
    """(query_id, chunk_id, score) of each query's best rows, ties by id.

    Only rows that may be among the best are sorted. By l2 they are found by a matrix
    product, whose error is bounded, and their distances are reckoned by differences.
    """
    if cosine:
        score = np.round(q @ v.T / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]) - 1.0, DIGITS) + 0.0
        near = -score
    else:
        own, other = (q * q).sum(axis=1), (v * v).sum(axis=1)
        near = own[:, None] + other[None, :] - 2.0 * (q @ v.T)
        # squares differ from their true value by less than this, and rounded distances tie within one step
        wrong = 8.0 * np.finfo(np.float64).eps * (q.shape[1] + 4) * (own + other.max(initial=0.0))
    out = []
    for k in range(len(q)):
        row = near[k]
        last = np.partition(row, limit - 1)[limit - 1] if len(row) > limit else np.inf
        if cosine:
            may = np.flatnonzero(~(row > last))
            s = score[k, may]
        else:
            if np.isfinite(last) and np.isfinite(wrong[k]):
                most = np.sqrt(max(last, 0.0) + wrong[k]) + 10.0**-DIGITS
                may = np.flatnonzero(~(row > most * most + wrong[k]))
            else:
                may = np.arange(len(row))
            s = np.round(-np.sqrt(((v[may] - q[k]) ** 2).sum(axis=1)), DIGITS) + 0.0
        top = np.lexsort((vid[may], -s))[:limit]
        out.append((np.full(len(top), qid[k]), vid[may[top]], s[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


HITS = "query_id long, chunk_id long, score double"


def _cut(hits: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= limit).drop("_place")


#: Blocks of queries whose best rows a task holds before it passes them on.
MOST_HELD = 1024


def _merged(a: tuple, b: tuple, limit: int) -> tuple:
    """Each query's best of two sets of (query_id, chunk_id, score)."""
    qid, vid, score = (np.concatenate(c) for c in zip(a, b, strict=True))
    order = np.lexsort((vid, -score, qid))
    qid = qid[order]
    first = np.searchsorted(qid, qid, "left")
    kept = np.arange(len(qid)) - first < limit
    return qid[kept], vid[order][kept], score[order][kept]


def nearest_each(vectors: DataFrame, queries: DataFrame, limit: int, metric: str = "cosine") -> DataFrame:
    """(query_id, chunk_id, score): nearest() of every query (chunk_id, vector) at once.

    Blocks of rows are dealt out and meet a copy of every block of queries where they are,
    for all vectors may be of one length. A task merges what it finds for a block of
    queries; the rest is merged per query.
    """
    check_limit(limit)
    cosine = metric == "cosine"
    parts = 4 * vectors.sparkSession.sparkContext.defaultParallelism

    def step(batches):
        held: dict[bytes, tuple] = {}
        passed = lambda: [pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "chunk_id", "score"]) for found in held.values()]
        for batch in batches:
            for k in range(batch.num_rows):
                width = batch.column(0)[k].as_py()
                name = batch.column(1)[k].as_py()
                qid, vid = np.frombuffer(name, "<i8"), np.frombuffer(batch.column(3)[k].as_py(), "<i8")
                q, v = (np.frombuffer(batch.column(j)[k].as_py(), "<f8").reshape(-1, width) for j in (2, 4))
                found = _best(q, v, qid, vid, limit, cosine)
                held[name] = _merged(held[name], found, limit) if name in held else found
                if len(held) > MOST_HELD:
                    yield from passed()
                    held.clear()
        yield from passed()

    q, v = _blocks(queries, 256, cosine, "q"), _blocks(vectors, 2048, cosine, "v")
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    v = v.withColumnRenamed("width", "v_width").withColumn("v_part", F.pmod(F.xxhash64("v_ids"), F.lit(parts)).cast("int"))
    met = q.join(v, (F.col("width") == F.col("v_width")) & (F.col("part") == F.col("v_part"))).select("width", "q_ids", "q_values", "v_ids", "v_values")
    return _cut(met.mapInArrow(step, HITS), limit)


#: Vectors, by hash, that centroids are fitted on; all rows are assigned.
FIT = 20_000


def centroids(vectors: DataFrame, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means on the FIT vectors of the smallest hashes."""

    def fit(table: pa.Table) -> pa.Table:
        x = np.array(table.column("vector").to_pylist(), np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        c = x[:lists]
        for _ in range(rounds):
            own = (x @ c.T).argmax(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            size = np.sqrt((total * total).sum(axis=1, keepdims=True))
            c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
        return pa.table({"c": pa.array(c.tolist(), pa.list_(pa.float64()))})

    sample = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(FIT).select("vector", F.lit(0).alias("all"))
    return np.array([r.c for r in sample.groupBy("all").applyInArrow(fit, "c array<double>").collect()])


def listed(vectors: DataFrame, made: np.ndarray, probes: int = 1) -> DataFrame:
    """Each row once for each of the ``probes`` lists whose centroids are nearest."""

    def step(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, made.shape[1])
            near = np.argsort(-(x @ made.T), axis=1, kind="stable")[:, :probes]
            of = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(of), batch.column(1).take(of)], ["list", "chunk_id", "vector"])

    return vectors.select(F.col("chunk_id").cast("long"), "vector").mapInArrow(step, "list int, chunk_id long, vector array<double>")


def ivf(vectors: DataFrame, queries: DataFrame, limit: int, least: float = 0.9) -> tuple[DataFrame, float]:
    """nearest_each() by cosine over probed lists, and its recall.

    Probes double until the mean recall over all queries, measured against every row, is ``least`` or more.
    """
    width = vectors.groupBy(F.size("vector").alias("w")).count().filter("w > 0").orderBy(F.desc("count"), "w").first()
    v = F.col("vector")
    fits = lambda df: df.filter((F.size(v) == (width.w if width else 1)) & ~F.exists(v, lambda x: x.isNull()) & (dot(v, v) > 0))
    vectors, queries = fits(vectors), fits(queries)
    exact = nearest_each(vectors, queries, limit).select("query_id", "chunk_id")
    want = exact.count()
    if not want:
        return nearest_each(vectors, queries, limit), 1.0
    made = centroids(vectors, max(1, math.isqrt(min(vectors.count(), FIT))))
    stored = listed(vectors, made)

    def step(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (qid, q), (vid, x) = ((t.column("chunk_id").to_numpy(), np.array(t.column("vector").to_pylist(), np.float64)) for t in (left, right))
        parts = [_best(q[k : k + 256], x, qid[k : k + 256], vid, limit, True) for k in range(0, len(q), 256)]
        return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "chunk_id", "score"), zip(*parts, strict=True), strict=True)})

    probes = max(1, len(made) // 8)
    while True:
        asked = listed(queries, made, probes)
        hits = _cut(asked.groupBy("list").cogroup(stored.groupBy("list")).applyInArrow(step, HITS), limit)
        recall = hits.join(exact, ["query_id", "chunk_id"], "left_semi").count() / want
        if recall >= least or probes >= len(made):
            return hits, recall
        probes *= 2


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def _uses(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term)))


def bm25(chunks: DataFrame, field: str, terms: list[str]) -> DataFrame:
    """chunks with ``score``; rows without any of the terms go.

    The terms are few (a query), so their frequencies are counted in the scan itself; the
    only exchange is one row of corpus statistics.
    """
    if not terms:
        raise ValueError("a query needs a term")
    # the generator keeps the tokens in a column of their own: each pass over the text makes them once, not once per use
    worded = chunks.select("*", F.explode(F.array(tokens(F.col(field)))).alias("_words"))
    counted = worded.withColumns({"_dl": F.size("_words")} | {f"_tf{k}": _uses(F.col("_words"), t) for k, t in enumerate(terms)})
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_tf{k}") > 0).cast("long")).alias(f"_df{k}") for k in range(len(terms))])
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"_tf{k}").cast("double"), F.col(f"_df{k}")
        idf = F.log(1.0 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    found = counted.filter(" OR ".join(f"_tf{k} > 0" for k in range(len(terms))))
    # one row of statistics, whatever the size of the corpus
    return found.crossJoin(F.broadcast(stats)).select(*chunks.columns, F.round(score, DIGITS).alias("score"))


#: Field bands: ids above title, title above text.
BANDS = (("page_id", 4.0), ("chunk_id", 4.0), ("title", 2.0), ("text", 1.0))


def banded(score: Column, band: float) -> Column:
    """A score squashed into its field's band."""
    s = F.greatest(score, F.lit(0.0))
    return F.lit(band) + s / (s + 1.0)


def lexical(chunks: DataFrame, terms: list[str], limit: int, phrase: str | None = None) -> DataFrame:
    """(chunk_id, page_id, field, score): best field of each chunk over all four fields, ids matched whole."""
    check_limit(limit)
    budget = min(4 * limit, 400)
    parts = []
    for order, (field, band) in enumerate(BANDS):
        if field in ("page_id", "chunk_id"):
            hit = chunks.filter(F.col(field).cast("string").isin(*terms)).withColumn("score", F.lit(1.0))
        else:
            hit = bm25(chunks, field, terms)
        if phrase:
            inside = F.contains(F.lower(F.col("title")), F.lit(phrase.lower())) | F.contains(F.lower(F.col("text")), F.lit(phrase.lower()))
            hit = hit.filter(inside)
        best = hit.select("chunk_id", "page_id", F.lit(field).alias("field"), F.lit(order).alias("ord"), F.round(banded(F.col("score"), band), DIGITS).alias("score"))
        parts.append(best.orderBy(F.desc("score"), "page_id", "chunk_id").limit(budget))
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    top = F.max_by(F.struct("field", "score"), F.struct("score", (-F.col("ord")).alias("o"))).alias("best")
    merged = every.groupBy("chunk_id", "page_id").agg(top).select("chunk_id", "page_id", "best.field", "best.score")
    return merged.orderBy(F.desc("score"), "page_id", "chunk_id").limit(limit)


def ranked(hits: DataFrame, out: str) -> DataFrame:
    """hits (at most MAX_LIMIT rows) with their 1-based rank by score, then id."""
    return hits.withColumn(out, F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).cast("long"))


@dataclass(frozen=True)
class Fusion:
    k: int = 60
    semantic_weight: float = 1.0
    lexical_weight: float = 1.0
    candidates: int = 100


def fuse(semantic: DataFrame, text: DataFrame, limit: int, how: Fusion = Fusion()) -> DataFrame:  # noqa: B008
    """Reciprocal-rank fusion of two candidate lists (chunk_id, score): score, ranks and the paths that found a chunk.

    Order: score, then lexical rank (missing last), then id.
    """
    s = ranked(semantic, "semantic_rank").select("chunk_id", "semantic_rank", F.lit(None).cast("long").alias("lexical_rank"))
    t = ranked(text, "lexical_rank").select("chunk_id", F.lit(None).cast("long").alias("semantic_rank"), "lexical_rank")
    both = s.unionByName(t).groupBy("chunk_id").agg(F.min("semantic_rank").alias("semantic_rank"), F.min("lexical_rank").alias("lexical_rank"))
    part = lambda w, rank: F.coalesce(F.lit(w) / (F.lit(how.k) + F.col(rank)), F.lit(0.0))
    score = F.round(part(how.semantic_weight, "semantic_rank") + part(how.lexical_weight, "lexical_rank"), 9)
    paths = F.concat_ws("+", F.when(F.col("semantic_rank").isNotNull(), F.lit("semantic")), F.when(F.col("lexical_rank").isNotNull(), F.lit("lexical")))
    return both.withColumns({"score": score, "paths": paths}).orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), "chunk_id").limit(limit)


def graph_boost(hits: DataFrame, edges: DataFrame, weight: float = 0.15, hops: int = 2) -> DataFrame:
    """Fused hits (at most MAX_LIMIT; chunk_id, page_id, score, paths) with rank_score.

    The seed is the first of the top three that both paths found. Pages of the other
    candidates within two hops, through candidates' pages only, gain
    min(seed * weight / hop, 0.95 * (seed - score)). Without a seed the order stays.
    """
    if not (0 < weight <= 0.5 and hops in (1, 2)):
        raise ValueError("weight must be in (0, 0.5] and hops 1 or 2")
    order = Window.orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), "chunk_id")
    placed = hits.withColumn("place", F.row_number().over(order))
    seed = placed.filter("place <= 3 AND paths = 'semantic+lexical' AND score > 0").orderBy("place").limit(1).select(F.col("page_id").alias("seed_page"), F.col("score").alias("seed_score"))
    pages = placed.select("page_id").distinct()
    near = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source"))
    near = near.join(pages.withColumnRenamed("page_id", "a"), "a", "left_semi").join(pages.withColumnRenamed("page_id", "b"), "b", "left_semi").distinct()
    one = seed.join(near, F.col("seed_page") == F.col("a")).select(F.col("b").alias("page_id"), F.lit(1).alias("hop"))
    reach = one
    if hops == 2:
        two = one.join(near, F.col("page_id") == F.col("a")).select(F.col("b").alias("page_id"), F.lit(2).alias("hop"))
        reach = one.union(two)
    reach = reach.groupBy("page_id").agg(F.min("hop").alias("hop"))
    joined = placed.join(reach, "page_id", "left").crossJoin(F.broadcast(seed.select("seed_page", "seed_score").groupBy().agg(F.max("seed_page").alias("seed_page"), F.max("seed_score").alias("seed_score"))))
    gain = F.least(F.col("seed_score") * weight / F.col("hop"), 0.95 * F.greatest(F.col("seed_score") - F.col("score"), F.lit(0.0)))
    moved = F.when(F.col("hop").isNotNull() & (F.col("page_id") != F.col("seed_page")), gain).otherwise(0.0)
    return joined.withColumn("rank_score", F.round(F.col("score") + F.coalesce(moved, F.lit(0.0)), 9)).drop("seed_page", "seed_score", "place")
