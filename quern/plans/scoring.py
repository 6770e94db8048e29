"""Evaluation over operators/evaluation.py: a query is a language, its ranking the longest documents, its judgments the labels (3 good and clean, 1 good or clean)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import evaluation as E
from quern.plans.common import Book
from quern.views import table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

JUDGED = """judged AS (SELECT d.lang AS query, d.doc_id AS doc, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 3 WHEN l.quality = 1 OR l.toxic = 0 THEN 1 ELSE 0 END AS grade FROM labels l JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL),
asked AS (SELECT DISTINCT lang AS query FROM documents WHERE lang IS NOT NULL UNION SELECT 'none'),
ranking AS (SELECT lang AS query, doc_id AS doc, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang IS NOT NULL),
graded AS (SELECT r.*, coalesce(j.grade, 0) AS grade FROM ranking r LEFT JOIN judged j USING (query, doc)),
ideal AS (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS rank FROM judged WHERE grade > 0),
rel AS (SELECT query, count(*) AS n FROM ideal GROUP BY query)"""


def _per(table_: str, k: int, what: str) -> str:
    return f"(SELECT query, sum({what}) AS v FROM {table_} WHERE rank <= {k} GROUP BY query)"


_GAIN = "(power(2e0, grade) - 1e0) / log2(rank + 1e0)"


def _columns(cutoffs=E.CUTOFFS) -> tuple[str, str]:
    names, joins = [], ["LEFT JOIN rel USING (query)"]
    for k in cutoffs:
        joins.append(f"LEFT JOIN {_per('graded', k, 'CASE WHEN grade > 0 THEN 1e0 ELSE 0e0 END')} h{k} USING (query) LEFT JOIN {_per('graded', k, _GAIN)} d{k} USING (query) LEFT JOIN {_per('ideal', k, _GAIN)} i{k} USING (query)")
        names += [f"round(coalesce(h{k}.v / rel.n, 0e0), 9) AS recall{k}", f"round(coalesce(CASE WHEN i{k}.v > 0 THEN d{k}.v / i{k}.v END, 0e0), 9) AS ndcg{k}"]
    joins.append("LEFT JOIN (SELECT query, max(CASE WHEN grade > 0 THEN 1e0 / rank ELSE 0e0 END) AS v FROM graded WHERE rank <= 10 GROUP BY query) m USING (query)")
    return ", ".join(names), " ".join(joins)


_NAMES, _JOINS = _columns()
METRICS = f"{JUDGED}, per AS (SELECT query, {_NAMES}, round(coalesce(m.v, 0e0), 9) AS mrr FROM asked {_JOINS})"
_EACH = [f"{m}{k}" for k in E.CUTOFFS for m in ("recall", "ndcg")] + ["mrr"]


def _tables(spark, sf_dir, k=10):
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("lang").alias("query"), F.col("doc_id").alias("doc"), "n_chars", "source")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), "quality", "toxic")
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 3).when((F.col("quality") == 1) | (F.col("toxic") == 0), 1).otherwise(0)
    judged = docs.select("query", "doc").join(labels.hint("merge"), "doc").select("query", "doc", grade.alias("grade"))
    asked = docs.select("query").distinct().union(spark.range(1).select(F.lit("none")))
    return asked, docs, E.best(docs, "query", [F.desc("n_chars"), F.col("doc")], k).select("query", "doc", "rank"), judged


@BOOK.query("ranking_metrics", f"WITH {METRICS} SELECT * FROM per")
def ranking_metrics(spark, sf_dir):
    """Recall and nDCG at 1, 3, 5 and 10 and MRR; a query without hits counts with zeros."""
    asked, _, ranking, judged = _tables(spark, sf_dir)
    return E.metrics(asked, ranking, judged)


@BOOK.query("ranking_macro", f"WITH {METRICS} SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in _EACH)}, count(*) AS queries FROM per")
def ranking_macro(spark, sf_dir):
    return E.macro(ranking_metrics(spark, sf_dir))


@BOOK.query("ranking_hits", f"WITH {JUDGED} SELECT query, bool_or(grade > 0) AS any_hit, bool_or(grade = 3) AS best_hit FROM graded WHERE rank <= 3 GROUP BY query")
def ranking_hits(spark, sf_dir):
    _, _, ranking, judged = _tables(spark, sf_dir)
    return E.hits_at(ranking, judged, 3)


@BOOK.query("ranking_cohorts", f"""WITH {METRICS}, about AS (SELECT query, left(query, 1) AS family, CAST(length(query) AS VARCHAR) AS size FROM per)
  SELECT 'family' AS attribute, family AS value, count(*) AS queries, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _EACH)} FROM per JOIN about USING (query) GROUP BY family
  UNION ALL SELECT 'size', size, count(*), {', '.join(f'round(avg({c}), 6)' for c in _EACH)} FROM per JOIN about USING (query) GROUP BY size""")
def ranking_cohorts(spark, sf_dir):
    per = ranking_metrics(spark, sf_dir)
    return E.cohorts(per, per.select("query", F.left("query", F.lit(1)).alias("family"), F.length("query").alias("size")), "family", "size")


@BOOK.query("ranking_coverage", f"""WITH {JUDGED} SELECT j.query, CAST(count(*) FILTER (WHERE r.doc IS NULL) AS BIGINT) AS missing, round(least(5, count(r.doc)) / CAST(least(5, count(*)) AS DOUBLE), 9) AS ceiling
  FROM judged j LEFT JOIN (SELECT * FROM ranking WHERE rank <= 100) r USING (query, doc) WHERE j.grade > 0 GROUP BY j.query""")
def ranking_coverage(spark, sf_dir):
    _, _, ranking, judged = _tables(spark, sf_dir, 100)
    return E.coverage(ranking, judged)


@BOOK.query("ranking_exact_gate", f"""WITH {JUDGED}, f AS (SELECT query, min(rank) AS rank FROM graded WHERE grade = 3 AND rank <= 10 GROUP BY query),
  t AS (SELECT a.query, coalesce(f.rank <= 1, FALSE) AS one, coalesce(f.rank <= 3, FALSE) AS three FROM asked a LEFT JOIN f USING (query)),
  r AS (SELECT avg(CAST(one AS DOUBLE)) AS top1, avg(CAST(three AS DOUBLE)) AS top3, min(CAST(one AS DOUBLE)) AS worst, (SELECT bool_and(x) FROM (SELECT bool_or(one) AS x FROM t GROUP BY left(query, 1))) AS each_family FROM t)
  SELECT round(top1, 9) AS top1, round(top3, 9) AS top3, round(worst, 9) AS worst_language, each_family, top1 >= 75e-2 AND top3 >= 75e-2 AND worst >= 5e-1 AND each_family AS passed FROM r""")
def ranking_exact_gate(spark, sf_dir):
    asked, _, ranking, judged = _tables(spark, sf_dir)
    first = ranking.join(judged.filter("grade = 3"), ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return E.exact_gate(first, asked.select("query", F.col("query").alias("language"), F.left("query", F.lit(1)).alias("family")))


@BOOK.query("ranking_boost_gate", f"""WITH {JUDGED}, moved AS (SELECT d.lang AS query, d.doc_id AS doc, row_number() OVER (PARTITION BY d.lang ORDER BY n_chars + CASE WHEN source IN ('src1', 'src2') THEN 300 ELSE 0 END DESC, doc_id) AS now FROM documents d WHERE d.lang IS NOT NULL),
  both_ranks AS (SELECT g.*, m.now FROM graded g JOIN moved m USING (query, doc)),
  gains AS (SELECT query, sum(CASE WHEN rank <= 3 THEN {_GAIN} ELSE 0e0 END) AS before, sum(CASE WHEN now <= 3 THEN (power(2e0, grade) - 1e0) / log2(now + 1e0) ELSE 0e0 END) AS after FROM both_ranks GROUP BY query),
  best AS (SELECT query, sum({_GAIN}) AS v FROM ideal WHERE rank <= 3 GROUP BY query),
  l AS (SELECT round(avg(round(coalesce(after / v, 0e0), 9) - round(coalesce(before / v, 0e0), 9)), 6) AS lift FROM gains LEFT JOIN best USING (query)),
  g AS (SELECT CAST(count(*) FILTER (WHERE now > 10 OR now > rank) AS BIGINT) AS regressions FROM both_ranks WHERE grade = 3 AND rank <= 10)
  SELECT lift, regressions, CASE WHEN lift > 1e-3 AND regressions = 0 THEN 'enable' ELSE 'keep_disabled' END AS decision FROM l, g""")
def ranking_boost_gate(spark, sf_dir):
    _, docs, ranking, judged = _tables(spark, sf_dir)
    lifted = F.col("n_chars") + F.when(F.col("source").isin("src1", "src2"), 300).otherwise(0)
    boosted = E.best(docs, "query", [lifted.desc(), F.col("doc")], 10).select("query", "doc", "rank")
    guards = ranking.join(judged.filter("grade = 3"), ["query", "doc"]).select("query", "doc")
    return E.boost_gate(ranking, boosted, judged, guards)
