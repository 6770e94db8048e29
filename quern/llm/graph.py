"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import drop_saved, saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long): root is the smallest node that is reachable.

    Large-star and small-star rounds (each node's neighbours are linked to the smallest of
    them) until only stars around their smallest nodes are left; some log(longest path)
    rounds. Each round's links are written to the shared folder. Hubs are pre-aggregated
    before the shuffle and joined by a sort-merge join, whose skewed partitions Spark can
    split. Loops and repeated links do no harm; null ends are ignored.
    """
    now = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = saved(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")), "link-ends")
        least = ends.select("a", F.least("a", "low").alias("m"))
        # in stars a node has larger neighbours alone, or one smaller one and no other
        if not ends.filter("low < a AND low < high").limit(1).count():
            break
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # from here each link points from the larger to the smaller end; there are no more than before
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        then = saved(small.filter("a <> b").distinct(), "links")
        for done in (now, ends):
            drop_saved(done)
        now = then
    return least.withColumnsRenamed({"a": "node", "m": "root"})
