"""Retrieval evaluation queries: graded metrics, cohorts, coverage and gates over judged rankings.

A query is a language; its ranking orders the judged documents by length; the grade comes
from the labels: 3 for good and clean, 1 for good or clean, 0 otherwise.
"""

from __future__ import annotations

from quern.plans.common import Book

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

JUDGED = """
judged AS (SELECT d.lang AS query, d.source AS category, d.doc_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 3 WHEN l.quality = 1 OR l.toxic = 0 THEN 1 ELSE 0 END AS grade, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, doc_id) AS rank, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc_id) AS ideal FROM judged),
per AS (SELECT query,
  sum(CASE WHEN grade > 0 AND rank <= 5 THEN 1e0 ELSE 0e0 END) / greatest(sum(CASE WHEN grade > 0 THEN 1e0 ELSE 0e0 END), 1e0) AS recall5,
  sum(CASE WHEN rank <= 5 THEN (power(2e0, grade) - 1e0) / log2(rank + 1e0) ELSE 0e0 END) AS dcg5,
  sum(CASE WHEN ideal <= 5 THEN (power(2e0, grade) - 1e0) / log2(ideal + 1e0) ELSE 0e0 END) AS idcg5,
  max(CASE WHEN grade > 0 THEN 1e0 / rank ELSE 0e0 END) AS mrr FROM ranked GROUP BY query)"""

BOOK.sql("eval_metrics", f"WITH {JUDGED} SELECT query, round(recall5, 9) AS recall5, round(CASE WHEN idcg5 > 0 THEN dcg5 / idcg5 ELSE 0e0 END, 9) AS ndcg5, round(mrr, 9) AS mrr FROM per")
BOOK.sql("eval_macro", f"WITH {JUDGED} SELECT round(avg(recall5), 9) AS recall5, round(avg(CASE WHEN idcg5 > 0 THEN dcg5 / idcg5 ELSE 0e0 END), 9) AS ndcg5, round(avg(mrr), 9) AS mrr, CAST(count(*) AS BIGINT) AS queries FROM per")
BOOK.sql("eval_cohorts", f"""WITH {JUDGED} SELECT query, category, CAST(count(*) AS BIGINT) AS judged, CAST(sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS BIGINT) AS relevant, CAST(sum(CASE WHEN grade = 3 AND rank <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS best_at_10
  FROM ranked GROUP BY GROUPING SETS ((query), (category))""")
BOOK.sql("candidate_coverage", f"""WITH {JUDGED} SELECT query, CAST(sum(CASE WHEN grade > 0 AND rank > 100 THEN 1 ELSE 0 END) AS BIGINT) AS missing, round(least(5e0, sum(CASE WHEN grade > 0 AND rank <= 100 THEN 1e0 ELSE 0e0 END)) / greatest(least(5e0, sum(CASE WHEN grade > 0 THEN 1e0 ELSE 0e0 END)), 1e0), 9) AS ceiling5 FROM ranked GROUP BY query""")
BOOK.sql("exact_gate", f"""WITH {JUDGED}, hit AS (SELECT query, max(CASE WHEN rank = 1 AND grade = 3 THEN 1e0 ELSE 0e0 END) AS top1, max(CASE WHEN rank <= 3 AND grade = 3 THEN 1e0 ELSE 0e0 END) AS top3 FROM ranked GROUP BY query)
  SELECT round(avg(top1), 9) AS top1, round(avg(top3), 9) AS top3, avg(top1) >= 75e-2 AND avg(top3) >= 75e-2 AS passed FROM hit""")
BOOK.sql("boost_gate", f"""WITH {JUDGED}, moved AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n_chars + CASE WHEN category IN ('src1', 'src2') THEN 300 ELSE 0 END DESC, doc_id) AS boosted FROM ranked),
  deltas AS (SELECT query, sum(CASE WHEN boosted <= 3 THEN (power(2e0, grade) - 1e0) / log2(boosted + 1e0) ELSE 0e0 END) - sum(CASE WHEN rank <= 3 THEN (power(2e0, grade) - 1e0) / log2(rank + 1e0) ELSE 0e0 END) AS lift,
    CAST(sum(CASE WHEN grade = 3 AND boosted > rank AND rank <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS regressions FROM moved GROUP BY query)
  SELECT round(avg(lift), 9) AS lift, CAST(sum(regressions) AS BIGINT) AS regressions, CASE WHEN avg(lift) > 1e-3 AND sum(regressions) = 0 THEN 'enable' ELSE 'keep_disabled' END AS decision FROM deltas""")
BOOK.sql("dataset_integrity", """SELECT CAST(count(*) FILTER (WHERE d.doc_id IS NULL) AS BIGINT) AS unresolved, CAST(count(*) FILTER (WHERE l.quality NOT IN (0, 1) OR l.toxic NOT IN (0, 1)) AS BIGINT) AS bad_grades, CAST(count(*) - count(DISTINCT l.doc_id) AS BIGINT) AS repeated, CAST(count(*) AS BIGINT) AS judged FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
