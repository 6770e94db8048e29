"""Search queries: vectors, BM25, bands, fusion and boost over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import search as S
from quern.plans.common import Book
from quern.views import chunks, query_terms, query_vector, vectors

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

COSINE = """
vec AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT v AS qv FROM vec WHERE chunk_id = 0)"""
TERMS = r"""
terms AS (SELECT DISTINCT term FROM (
  SELECT term, min(pos) AS pos FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS pos
    FROM benchmark WHERE item_id = 0) GROUP BY term ORDER BY pos LIMIT 3)),
chunk AS (SELECT doc_id AS chunk_id, doc_id // 4 AS page_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS text FROM documents)"""


def bm25_sql(field: str, name: str) -> str:
    return rf"""
{name}_t AS (SELECT chunk_id, page_id, regexp_extract_all(lower({field}), '[\p{{L}}\p{{N}}]+') AS words FROM chunk),
{name}_tf AS (SELECT chunk_id, page_id, term, len(words) AS dl, len(list_filter(words, lambda w: w = term)) AS tf FROM {name}_t, terms),
{name}_s AS (SELECT count(*) AS n, avg(len(words)) AS a FROM {name}_t),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf WHERE tf > 0 GROUP BY term),
{name} AS (SELECT chunk_id, page_id, round(sum(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / a))), 6) AS score
  FROM {name}_tf JOIN {name}_df USING (term), {name}_s WHERE tf > 0 GROUP BY chunk_id, page_id)"""


@BOOK.query("knn_cosine", f"WITH {COSINE} SELECT chunk_id, round(-(1e0 - list_cosine_similarity(v, qv)), 6) + 0e0 AS score FROM vec, q ORDER BY score DESC, chunk_id LIMIT 20")
def knn_cosine(spark, sf_dir):
    return S.nearest(vectors(spark, sf_dir), query_vector(spark, sf_dir), 20)


@BOOK.query("knn_l2", f"WITH {COSINE} SELECT chunk_id, round(-list_distance(v, qv), 6) + 0e0 AS score FROM vec, q ORDER BY score DESC, chunk_id LIMIT 20")
def knn_l2(spark, sf_dir):
    return S.nearest(vectors(spark, sf_dir), query_vector(spark, sf_dir), 20, "l2")


@BOOK.query("knn_filtered", f"WITH {COSINE} SELECT chunk_id, round(-(1e0 - list_cosine_similarity(v, qv)), 6) + 0e0 AS score FROM vec, q WHERE label IN (1, 3, 5) ORDER BY score DESC, chunk_id LIMIT 20")
def knn_filtered(spark, sf_dir):
    return S.nearest(vectors(spark, sf_dir).filter(F.col("label").isin(1, 3, 5)), query_vector(spark, sf_dir), 20)


@BOOK.query("knn_ivf_probe", f"""WITH {COSINE},
  parts AS (SELECT label, list(v) AS vs FROM vec GROUP BY label),
  dims AS (SELECT label, i, avg(v[i]) AS m FROM vec, generate_series(1, 64) g(i) GROUP BY label, i),
  centroids AS (SELECT label, list(m ORDER BY i) AS c FROM dims GROUP BY label),
  probed AS (SELECT label FROM centroids, q ORDER BY round(list_cosine_similarity(c, qv), 6) DESC, label LIMIT 2)
  SELECT chunk_id, round(-(1e0 - list_cosine_similarity(v, qv)), 6) + 0e0 AS score FROM vec, q WHERE label IN (SELECT label FROM probed) ORDER BY score DESC, chunk_id LIMIT 20""")
def knn_ivf_probe(spark, sf_dir):
    """Partitions are labels; the two whose centroids are nearest are searched."""
    v = vectors(spark, sf_dir)
    q = query_vector(spark, sf_dir)
    means = v.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    near = F.round(S.cosine_similarity(F.col("c"), F.array(*[F.lit(x) for x in q])), S.DIGITS)
    probed = centroids.orderBy(near.desc(), "label").limit(2).select("label")
    return S.nearest(v.join(F.broadcast(probed), "label", "left_semi"), q, 20)


#: The query set: every row whose id is divisible by 50, against all rows.
EACH = """
vec AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT chunk_id AS query_id, v AS qv FROM vec WHERE chunk_id % 50 = 0)"""
EACH_CUT = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20"


def _each(v, metric="cosine", rows=None):
    return S.nearest_each(v if rows is None else rows, v.filter("chunk_id % 50 = 0"), 20, metric)


@BOOK.query("knn_cosine_each", f"WITH {EACH} SELECT query_id, chunk_id, round(-(1e0 - list_cosine_similarity(v, qv)), 6) + 0e0 AS score FROM vec, q {EACH_CUT}")
def knn_cosine_each(spark, sf_dir):
    return _each(vectors(spark, sf_dir))


@BOOK.query("knn_l2_each", f"WITH {EACH} SELECT query_id, chunk_id, round(-list_distance(v, qv), 6) + 0e0 AS score FROM vec, q {EACH_CUT}")
def knn_l2_each(spark, sf_dir):
    return _each(vectors(spark, sf_dir), "l2")


@BOOK.query("knn_filtered_each", f"WITH {EACH} SELECT query_id, chunk_id, round(-(1e0 - list_cosine_similarity(v, qv)), 6) + 0e0 AS score FROM vec, q WHERE label IN (1, 3, 5) {EACH_CUT}")
def knn_filtered_each(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _each(v, rows=v.filter(F.col("label").isin(1, 3, 5)))


@BOOK.query("knn_ivf_each", f"WITH {EACH} SELECT CAST(count(*) AS BIGINT) AS queries, TRUE AS reached FROM q")
def knn_ivf_each(spark, sf_dir):
    """Lists around fitted centroids, probed until recall against all rows is 0.9 over the query set: whether it was reached."""
    v = vectors(spark, sf_dir)
    hits, recall = S.ivf(v, v.filter("chunk_id % 50 = 0"), 20)
    return hits.agg(F.countDistinct("query_id").alias("queries"), F.lit(recall >= 0.9).alias("reached"))


def _bm25(spark, sf_dir, field):
    return S.bm25(chunks(spark, sf_dir), field, query_terms(spark, sf_dir)).select("chunk_id", "page_id", "score")


@BOOK.query("bm25_text", f"WITH {TERMS}, {bm25_sql('text', 'b')} SELECT chunk_id, page_id, score FROM b")
def bm25_text(spark, sf_dir):
    return _bm25(spark, sf_dir, "text")


@BOOK.query("bm25_title", f"WITH {TERMS}, {bm25_sql('title', 'b')} SELECT chunk_id, page_id, score FROM b")
def bm25_title(spark, sf_dir):
    return _bm25(spark, sf_dir, "title")


LEXICAL = f"""{TERMS}, {bm25_sql('text', 'tx')}, {bm25_sql('title', 'ti')},
cand AS (
  SELECT * FROM (SELECT chunk_id, page_id, 'title' AS field, 2 AS ord, round(2 + greatest(score, 0) / (1 + greatest(score, 0)), 6) AS score FROM ti ORDER BY score DESC, page_id, chunk_id LIMIT 80)
  UNION ALL SELECT * FROM (SELECT chunk_id, page_id, 'text', 3, round(1 + greatest(score, 0) / (1 + greatest(score, 0)), 6) AS score FROM tx ORDER BY score DESC, page_id, chunk_id LIMIT 80)
  UNION ALL SELECT chunk_id, page_id, 'chunk_id', 1, 45e-1 FROM chunk WHERE CAST(chunk_id AS VARCHAR) IN (SELECT term FROM terms)
  UNION ALL SELECT chunk_id, page_id, 'page_id', 0, 45e-1 FROM chunk WHERE CAST(page_id AS VARCHAR) IN (SELECT term FROM terms)),
lexical AS (SELECT chunk_id, page_id, arg_max(field, score * 10 - ord * 1e-9) AS field, max(score) AS score FROM cand GROUP BY chunk_id, page_id)"""


@BOOK.query("lexical_banded", f"WITH {LEXICAL} SELECT chunk_id, page_id, field, score FROM lexical ORDER BY score DESC, page_id, chunk_id LIMIT 20")
def lexical_banded(spark, sf_dir):
    return S.lexical(chunks(spark, sf_dir), query_terms(spark, sf_dir), 20)


@BOOK.query("phrase_search", f"""WITH {TERMS}, {bm25_sql('text', 'tx')},
  p AS (SELECT term FROM terms ORDER BY term LIMIT 1)
  SELECT chunk_id, page_id, score FROM tx JOIN chunk USING (chunk_id, page_id), p WHERE contains(lower(chunk.text), p.term) OR contains(lower(chunk.title), p.term)""")
def phrase_search(spark, sf_dir):
    """A quoted phrase narrows a field's hits by substring, ignoring case."""
    terms = query_terms(spark, sf_dir)
    phrase = min(terms)
    hit = S.bm25(chunks(spark, sf_dir), "text", terms)
    inside = F.contains(F.lower("title"), F.lit(phrase)) | F.contains(F.lower("text"), F.lit(phrase))
    return hit.filter(inside).select("chunk_id", "page_id", "score")


def _branches(spark, sf_dir):
    docs = chunks(spark, sf_dir)
    known = vectors(spark, sf_dir).join(docs.select("chunk_id"), "chunk_id", "left_semi")
    semantic = S.nearest(known, query_vector(spark, sf_dir), 100)
    text = S.bm25(docs, "text", query_terms(spark, sf_dir)).select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(100)
    return semantic, text


def fused_sql(sw: str, lw: str) -> str:
    return f"""{COSINE}, {TERMS}, {bm25_sql('text', 'tx')},
sem AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS semantic_rank FROM (
  SELECT chunk_id, round(-(1e0 - list_cosine_similarity(v, qv)), 6) + 0e0 AS score FROM vec, q WHERE chunk_id IN (SELECT chunk_id FROM chunk) ORDER BY score DESC, chunk_id LIMIT 100)),
lex AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS lexical_rank FROM (SELECT chunk_id, score FROM tx ORDER BY score DESC, chunk_id LIMIT 100)),
fused AS (SELECT chunk_id, semantic_rank, lexical_rank,
  round(coalesce({sw} / (60 + semantic_rank), 0e0) + coalesce({lw} / (60 + lexical_rank), 0e0), 9) AS score,
  concat_ws('+', CASE WHEN semantic_rank IS NOT NULL THEN 'semantic' END, CASE WHEN lexical_rank IS NOT NULL THEN 'lexical' END) AS paths
  FROM sem FULL JOIN lex USING (chunk_id))"""


CUT = "SELECT chunk_id, CAST(semantic_rank AS BIGINT) AS semantic_rank, CAST(lexical_rank AS BIGINT) AS lexical_rank, score, paths FROM fused ORDER BY score DESC, lexical_rank ASC NULLS LAST, chunk_id LIMIT 10"


@BOOK.query("hybrid_rrf", f"WITH {fused_sql('1e0', '1e0')} {CUT}")
def hybrid_rrf(spark, sf_dir):
    return S.fuse(*_branches(spark, sf_dir), 10)


@BOOK.query("hybrid_rrf_weighted", f"WITH {fused_sql('1e0', '5e-1')} {CUT}")
def hybrid_rrf_weighted(spark, sf_dir):
    return S.fuse(*_branches(spark, sf_dir), 10, S.Fusion(lexical_weight=0.5))


@BOOK.query("boost_disabled", f"WITH {fused_sql('1e0', '1e0')} SELECT chunk_id, score AS rank_score FROM fused ORDER BY score DESC, lexical_rank ASC NULLS LAST, chunk_id LIMIT 10")
def boost_disabled(spark, sf_dir):
    """Without the graph the fused order passes through."""
    return S.fuse(*_branches(spark, sf_dir), 10).select("chunk_id", F.col("score").alias("rank_score"))


@BOOK.query("graph_boost", f"""WITH {fused_sql('1e0', '1e0')},
top AS (SELECT *, chunk_id // 4 AS page_id FROM fused ORDER BY score DESC, lexical_rank ASC NULLS LAST, chunk_id LIMIT 50),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, lexical_rank ASC NULLS LAST, chunk_id) AS place FROM top),
seed AS (SELECT page_id AS sp, score AS ss FROM placed WHERE place <= 3 AND paths = 'semantic+lexical' AND score > 0 ORDER BY place LIMIT 1),
pg AS (SELECT DISTINCT page_id FROM placed),
e AS (SELECT page_id AS a, page_id + 3 AS b FROM pg UNION SELECT page_id + 3, page_id FROM pg),
near AS (SELECT DISTINCT a, b FROM e WHERE a IN (SELECT page_id FROM pg) AND b IN (SELECT page_id FROM pg)),
reach AS (SELECT page_id, min(hop) AS hop FROM (
  SELECT b AS page_id, 1 AS hop FROM near, seed WHERE a = sp
  UNION ALL SELECT n2.b, 2 FROM near n1 JOIN near n2 ON n1.b = n2.a, seed WHERE n1.a = sp) GROUP BY page_id)
SELECT chunk_id, page_id, score, round(score + coalesce(CASE WHEN hop IS NOT NULL AND page_id <> sp THEN least(ss * 15e-2 / hop, 95e-2 * greatest(ss - score, 0e0)) ELSE 0e0 END, 0e0), 9) AS rank_score
FROM placed LEFT JOIN reach USING (page_id) LEFT JOIN seed ON TRUE""")
def graph_boost(spark, sf_dir):
    """Pages link to the third page after them."""
    hits = S.fuse(*_branches(spark, sf_dir), 50).withColumn("page_id", F.floor(F.col("chunk_id") / 4).cast("long"))
    edges = chunks(spark, sf_dir).select(F.col("page_id").alias("source"), (F.col("page_id") + 3).alias("target")).distinct()
    return S.graph_boost(hits, edges).select("chunk_id", "page_id", "score", "rank_score")


BOOK.sql("chunk_filter_typed", "SELECT doc_id AS chunk_id, lang AS workspace_id, source AS root_id FROM documents WHERE lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2') AND n_chars >= 500 ORDER BY n_chars DESC, doc_id LIMIT 100")
BOOK.sql("root_narrowing", "SELECT source AS root_id, CAST(count(*) AS BIGINT) AS chunks FROM documents WHERE source IN ('src1', 'src2', 'src3') AND source IN ('src2', 'src3', 'src99') GROUP BY source")
BOOK.sql("property_filters", "SELECT event_id, event_type FROM events WHERE props IS NOT NULL AND event_type = 'purchase' AND value IS NOT NULL AND value >= 10")
BOOK.sql("edited_half_open", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'")
BOOK.sql("bounded_projection", "SELECT doc_id AS chunk_id, substring(text, 1, 2000) AS snippet, length(text) > 2000 AS overflow FROM documents")
BOOK.sql("source_partition_counts", "SELECT source AS root_id, lang AS workspace_id, CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT IDIV(doc_id ; 4)) AS BIGINT) AS pages FROM documents GROUP BY source, lang")


@BOOK.query("hit_validity", f"WITH {fused_sql('1e0', '1e0')}, top AS ({CUT}) SELECT CAST(count(*) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE score IS NULL OR isnan(score) OR isinf(score)) AS BIGINT) AS not_finite, CAST(count(*) - count(DISTINCT chunk_id) AS BIGINT) AS repeated FROM top")
def hit_validity(spark, sf_dir):
    hits = S.fuse(*_branches(spark, sf_dir), 10)
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    return hits.agg(F.count("*").alias("hits"), F.count_if(bad).alias("not_finite"), (F.count("*") - F.countDistinct("chunk_id")).alias("repeated"))
