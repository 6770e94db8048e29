"""Graded retrieval metrics over rankings and judgments, cohorts, coverage and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)
DIGITS = 9
#: Means of rounded values are rounded further, so that halves don't depend on how they are summed.
MEAN_DIGITS = 6


def best(candidates: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """candidates' best k of each query with their rank; tasks cut their own rows first, so no query is sorted whole."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("rank") <= k)


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def metrics(queries: DataFrame, ranking: DataFrame, judgments: DataFrame, top_k: int = 10) -> DataFrame:
    """Per query recall and nDCG at each cutoff up to top_k, and MRR.

    queries: query; ranking: query, doc, rank, ranks of 1 to top_k; judgments: query, doc,
    grade. What isn't judged has grade 0; queries without hits have zeros.
    """
    cutoffs = [k for k in CUTOFFS if k <= top_k]
    judged = judgments.filter("grade > 0")
    met = ranking.join(judged.hint("merge"), ["query", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    within = lambda k, value: F.sum(F.when(F.col("rank") <= k, value).otherwise(0.0))
    found = met.groupBy("query").agg(
        *[within(k, (F.col("grade") > 0).cast("double")).alias(f"hit{k}") for k in cutoffs],
        *[within(k, _gain(F.col("grade"), F.col("rank"))).alias(f"dcg{k}") for k in cutoffs],
        F.max(F.when(F.col("grade") > 0, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
    )
    ideal = best(judged, "query", [F.desc("grade")], max(cutoffs)).groupBy("query").agg(*[within(k, _gain(F.col("grade"), F.col("rank"))).alias(f"ideal{k}") for k in cutoffs])
    relevant = judged.groupBy("query").agg(F.count("*").alias("relevant"))
    rows = queries.select("query").distinct()
    for part in (found, ideal, relevant):
        rows = rows.join(part, "query", "left")
    share = lambda a, b: F.round(F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0)), DIGITS)
    return rows.select("query", *[share(f"hit{k}", "relevant").alias(f"recall{k}") for k in cutoffs], *[share(f"dcg{k}", f"ideal{k}").alias(f"ndcg{k}") for k in cutoffs], F.round(F.coalesce("mrr", F.lit(0.0)), DIGITS).alias("mrr"))


def macro(per_query: DataFrame) -> DataFrame:
    """The mean over all queries, those without hits included."""
    names = [c for c in per_query.columns if c != "query"]
    return per_query.agg(*[F.round(F.avg(c), MEAN_DIGITS).alias(c) for c in names], F.count("*").alias("queries"))


def hits_at(ranking: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """(query, any_hit, best_hit): whether something relevant, and something of grade 3, is in the first k."""
    met = ranking.filter(F.col("rank") <= k).join(judgments.hint("merge"), ["query", "doc"], "left")
    return met.groupBy("query").agg(F.coalesce(F.max(F.col("grade") > 0), F.lit(False)).alias("any_hit"), F.coalesce(F.max(F.col("grade") == 3), F.lit(False)).alias("best_hit"))


def cohorts(per_query: DataFrame, about: DataFrame, *names: str) -> DataFrame:
    """Means of per_query's metrics by each of the named attributes of queries (query, names) in turn: attribute, value, and the means."""
    metrics = [c for c in per_query.columns if c != "query"]
    met = per_query.join(about, "query")
    parts = [met.groupBy(F.lit(n).alias("attribute"), F.col(n).cast("string").alias("value")).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), MEAN_DIGITS).alias(c) for c in metrics]) for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def coverage(ranking: DataFrame, judgments: DataFrame, at: int = 5) -> DataFrame:
    """(query, missing, ceiling): relevant documents that the candidates lack, and the best recall at ``at`` that any order of them could have."""
    met = judgments.filter("grade > 0").join(ranking.select("query", "doc", F.lit(1).alias("there")).hint("merge"), ["query", "doc"], "left")
    by = met.groupBy("query").agg(F.count("*").alias("judged"), F.count("there").alias("found"))
    return by.select("query", (F.col("judged") - F.col("found")).alias("missing"), F.round(F.least(F.lit(at), "found") / F.least(F.lit(at), "judged"), DIGITS).alias("ceiling"))


def exact_gate(first: DataFrame, about: DataFrame, floor: float = 0.75, half: float = 0.5) -> DataFrame:
    """One row: rates of queries whose target is first and among the first three, and whether they pass.

    first: query, rank of the target (null: not found); about: query, language, family.
    Passes if both rates reach the floor, each language's first rate half, and each family has one.
    """
    met = about.join(first, "query", "left")
    top = lambda k: F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double"))
    languages = met.groupBy("language").agg(top(1).alias("rate")).agg(F.min("rate").alias("worst_language"))
    families = met.groupBy("family").agg(F.max(F.coalesce(F.col("rank") == 1, F.lit(False))).alias("one")).agg(F.min("one").alias("each_family"))
    whole = met.agg(top(1).alias("top1"), top(3).alias("top3"))
    rows = whole.crossJoin(languages).crossJoin(families)  # one row each
    passed = (F.col("top1") >= floor) & (F.col("top3") >= floor) & (F.col("worst_language") >= half) & F.col("each_family")
    return rows.select(*[F.round(c, DIGITS).alias(c) for c in ("top1", "top3", "worst_language")], "each_family", passed.alias("passed"))


def boost_gate(baseline: DataFrame, boosted: DataFrame, judgments: DataFrame, guards: DataFrame, least: float = 0.001) -> DataFrame:
    """One row: the mean lift of nDCG@3, guards (query, doc) whose rank fell, and the decision."""
    queries = baseline.select("query").union(boosted.select("query")).distinct()
    then = metrics(queries, boosted, judgments, 3).select("query", F.col("ndcg3").alias("after"))
    lift = metrics(queries, baseline, judgments, 3).select("query", F.col("ndcg3").alias("before")).join(then, "query").agg(F.round(F.avg(F.col("after") - F.col("before")), MEAN_DIGITS).alias("lift"))
    moved = guards.join(baseline.select("query", "doc", F.col("rank").alias("was")).hint("merge"), ["query", "doc"]).join(boosted.select("query", "doc", F.col("rank").alias("now")).hint("merge"), ["query", "doc"], "left")
    fell = moved.agg(F.count_if(F.col("now").isNull() | (F.col("now") > F.col("was"))).alias("regressions"))
    return lift.crossJoin(fell).withColumn("decision", F.when((F.col("lift") > least) & (F.col("regressions") == 0), "enable").otherwise("keep_disabled"))  # one row each
