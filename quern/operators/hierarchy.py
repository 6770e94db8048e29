"""Trees of any size and depth: chains by pointer doubling, walks by frontier joins.

Each round's table is checkpointed to the shared folder, so plans stay short and a lost
executor loses nothing; neither depth nor rows are bounded by a recursion limit.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df from the shared folder of spark.checkpoint.dir; one of its own is set only where that is unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def climbed(nodes: DataFrame, all_of: dict[str, Column] | None = None, any_of: dict[str, Column] | None = None) -> DataFrame:
    """(id, depth, root, whole, and a column for each condition) of every node (id, parent, ...).

    all_of holds of a node where it holds of it and all its ancestors, any_of where it
    holds of one of them. root is the topmost ancestor that is there; whole is false where
    a parent is missing or the chain runs in a circle (then root is null).
    Chains double in length with each round, so rounds are the logarithm of the depth.
    """
    all_of, any_of = all_of or {}, any_of or {}
    flags = [*all_of, *any_of]
    own = {**all_of, **any_of}
    state = nodes.select("id", F.col("parent").alias("up"), F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), *[own[f].alias(f) for f in flags])
    # a parent that isn't there ends the chain
    there = nodes.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    state = kept(state.join(there.hint("merge"), "up", "left").withColumn("whole", F.col("up").isNull() | F.coalesce("there", F.lit(False))).withColumn("up", F.when(F.col("there"), F.col("up"))).drop("there"))
    total, rounds = state.count(), 0
    while state.filter("up IS NOT NULL").limit(1).count():
        if 1 << rounds > total:  # longer than any chain without a circle
            state = state.withColumns({"root": F.when(F.col("up").isNull(), F.col("root")), "whole": F.col("whole") & F.col("up").isNull()})
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"), F.col("whole").alias("above_whole"), *[F.col(f).alias(f"above_{f}") for f in flags])
        met = state.join(above.hint("merge"), "up", "left")
        climbs = F.col("up").isNotNull()
        columns = {
            "root": F.when(climbs, F.col("top")).otherwise(F.col("root")),
            "whole": F.when(climbs, F.col("above_whole")).otherwise(F.col("whole")),
            "depth": F.when(climbs, F.col("depth") + 1 + F.col("more")).otherwise(F.col("depth")),
        }
        columns |= {f: F.when(climbs, (F.col(f) & F.col(f"above_{f}")) if f in all_of else (F.col(f) | F.col(f"above_{f}"))).otherwise(F.col(f)) for f in flags}
        state = kept(met.select("id", F.col("next").alias("up"), *[c.alias(n) for n, c in columns.items()]))
        rounds += 1
    return state.select("id", "depth", "root", "whole", *flags)


def authorized(nodes: DataFrame, live: Column, root: Column, excluded: Column) -> DataFrame:
    """(id, decision): excluded if it or an ancestor is; authorized if its whole chain is live and holds a root; else broken or out_of_scope."""
    chain = climbed(nodes, {"all_live": live}, {"in_root": root, "left_out": excluded})
    decision = F.when(F.col("left_out"), "excluded").when(~F.col("whole") | ~F.col("all_live"), "broken").when(F.col("in_root"), "authorized").otherwise("out_of_scope")
    return chain.select("id", decision.alias("decision"))


def walked(claims: DataFrame, roots: DataFrame, proof: DataFrame, unreadable: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(id, parent, depth) of all that is reachable from roots (id), and whether the walk is complete.

    claims: parent, child. A claim counts only where proof (id, parent) names that parent;
    other claims are rejected, and a later right one still finds the child. Each id is
    visited once, by the smallest parent of its first round. Children of unreadable ids
    aren't followed and make the walk incomplete.
    """
    true = claims.join(proof.select(F.col("id").alias("child"), "parent").hint("merge"), ["child", "parent"], "left_semi").distinct()
    seen = kept(roots.select("id", F.lit(None).cast(dict(proof.dtypes)["parent"]).alias("parent"), F.lit(0).cast("long").alias("depth")).distinct())
    frontier, depth, complete = seen, 0, True
    while True:
        open_ids = frontier.select("id")
        if unreadable is not None:
            complete &= not open_ids.join(unreadable, "id", "left_semi").limit(1).count()
            open_ids = open_ids.join(unreadable, "id", "left_anti")
        found = true.join(open_ids.withColumnRenamed("id", "parent").hint("merge"), "parent", "left_semi").groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent"))
        depth += 1
        frontier = kept(found.join(seen.select("id").hint("merge"), "id", "left_anti").select("id", "parent", F.lit(depth).cast("long").alias("depth")))
        if not frontier.limit(1).count():
            return seen, complete
        seen = kept(seen.union(frontier))


def descended(nodes: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(id, parent, depth): roots (id, parent) at 0 and what of nodes (id, parent) lies below them, at its least depth, ``most`` at the deepest.

    A pair of id and parent is followed once, in the first round that finds it.
    """
    pairs = nodes.select("id", "parent")
    seen = kept(roots.select("id", "parent", F.lit(0).cast("long").alias("depth")).distinct())
    frontier = seen
    for depth in range(1, most + 1):
        found = pairs.join(frontier.select(F.col("id").alias("parent")).distinct().hint("merge"), "parent", "left_semi").select("id", "parent").distinct()
        known = seen.select(F.col("id").alias("known"), F.col("parent").alias("below"))
        fresh = found.join(known.hint("merge"), F.col("id").eqNullSafe(F.col("known")) & (F.col("parent") == F.col("below")), "left_anti")
        frontier = kept(fresh.withColumn("depth", F.lit(depth).cast("long")))
        if not frontier.limit(1).count():
            break
        seen = kept(seen.union(frontier))
    return seen


def visit_outcome(excluded: Column, has_metadata: Column, parent_proven: Column, trashed: Column, has_body: Column) -> Column:
    """Why a page visit ends early, in the order of its checks; null where it is read."""
    return F.when(excluded, "excluded").when(~has_metadata, "unreadable").when(~parent_proven, "wrong_parent").when(trashed, "trashed").when(~has_body, "no_body")


def rows_of_databases(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """(database, rows, complete): rows of every data source, read by cursor pages (source, cursor, next_cursor, n); a cursor that repeats or is missing leaves it incomplete."""
    known = pages.select("source", F.col("cursor").alias("next_cursor"), F.lit(1).alias("here"))
    linked = pages.join(known.dropDuplicates(["source", "next_cursor"]).hint("merge"), ["source", "next_cursor"], "left")
    per = linked.groupBy("source").agg(
        F.sum("n").alias("n"),
        (F.count("*") > F.count_distinct(F.coalesce("cursor", F.lit("")))).alias("repeats"),
        F.max(F.col("next_cursor").isNotNull() & F.col("here").isNull()).alias("missing"),
    )
    met = sources.join(per.hint("merge"), "source", "left")
    whole = F.coalesce(~F.col("repeats") & ~F.col("missing"), F.lit(False))
    return met.groupBy("database").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min(whole).alias("complete"))
