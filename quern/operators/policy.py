"""Who may do what, and when: capabilities, destructive requests, fences and freshness, as Column expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The known operations by category (fixed values); all others are denied.
READS = ("knowledge_search", "knowledge_get", "knowledge_related", "knowledge_sync_status")
WRITES = ("knowledge_upload_file", "knowledge_file_refresh", "knowledge_create_page", "knowledge_append", "knowledge_update_section", "knowledge_archive_page")
DESTRUCTIVE = ("update", "replace", "archive", "delete")


def _selected(operation: Column, selectors: list[str]) -> Column:
    """Whether a list names the operation or its category (read or write)."""
    names = [x for s in selectors for x in {"read": READS, "write": WRITES}.get(s, (s,))]
    return operation.isin(*names)


def allowed(operation: Column, allow: list[str] | None = None, block: list[str] = (), read_only: bool = False) -> Column:
    """Why an operation is denied, or ``allowed``: unknown, blocked (before any allow list), read_only, not_listed. No allow list allows all, an empty one none."""
    made = F.when(~F.coalesce(operation.isin(*READS, *WRITES), F.lit(False)), "unknown").when(_selected(operation, block), "blocked")
    if read_only:
        made = made.when(~operation.isin(*READS), "read_only")
    if allow is not None:
        made = made.when(~_selected(operation, allow), "not_listed")
    return made.otherwise("allowed")


def confirmation(requests: DataFrame, permits: DataFrame, enabled: bool) -> DataFrame:
    """requests (id, operation, digest, at) with a decision: destructive ones need a permit (permit, digest) of their very request, which one request consumes."""
    if not enabled:
        return requests.withColumn("decision", F.when(F.col("operation").isin(*DESTRUCTIVE), "disabled").otherwise("allowed"))
    first = requests.filter(F.col("operation").isin(*DESTRUCTIVE)).groupBy("digest").agg(F.min(F.struct("at", "id")).alias("first"))
    held = permits.select("digest", F.lit(True).alias("permitted")).distinct()
    met = requests.join(first.hint("merge"), "digest", "left").join(held.hint("merge"), "digest", "left")
    decision = F.when(~F.col("operation").isin(*DESTRUCTIVE), "allowed").when(F.col("permitted").isNull(), "no_permit").when(F.struct("at", "id") == F.col("first"), "allowed").otherwise("consumed")
    return met.select(*requests.columns, decision.alias("decision"))


def search_open(receipts: DataFrame) -> DataFrame:
    """(generation, open): a generation with a pending or failed last receipt is closed to search; receipts: generation, operation, at, status."""
    last = receipts.groupBy("generation", "operation").agg(F.max_by("status", "at").alias("status"))
    return last.groupBy("generation").agg((F.count_if(F.col("status").isin("pending", "failed")) == 0).alias("open"))


def authority(epochs: DataFrame, unresolved: DataFrame, named: DataFrame) -> DataFrame:
    """(scope, verdict) of a change: epochs: scope, epoch, generation, next_epoch, next_generation; unresolved and named: scope, operation.

    Epoch and generation must advance, and what the change supersedes must be exactly what is unresolved.
    """
    a, b = unresolved.distinct().withColumn("open", F.lit(1)), named.distinct().withColumn("said", F.lit(1))
    unlike = a.join(b, ["scope", "operation"], "full").groupBy("scope").agg(F.count_if(F.col("open").isNull() | F.col("said").isNull()).alias("unlike"))
    verdict = F.when(~((F.col("next_epoch") > F.col("epoch")) & (F.col("next_generation") > F.col("generation"))), "not_advanced").when(F.coalesce("unlike", F.lit(0)) > 0, "other_set").otherwise("accepted")
    return epochs.join(unlike, "scope", "left").select("scope", verdict.alias("verdict"))


def healthy(observations: DataFrame, now_ms: Column, stale_ms: int = 90_000) -> DataFrame:
    """(subject, health) from the last observation of each dependency (subject, dependency, at_ms, ok): unknown if one is stale, else whether all are well."""
    last = observations.groupBy("subject", "dependency").agg(F.max_by("ok", "at_ms").alias("ok"), F.max("at_ms").alias("at_ms"))
    stale = F.max(now_ms - F.col("at_ms") > stale_ms)
    return last.groupBy("subject").agg(F.when(stale, "unknown").when(F.min("ok"), "healthy").otherwise("unhealthy").alias("health"))


def written_matches(written: Column, read_back: Column) -> Column:
    """Equal, or apart by one final line feed."""
    return (written == read_back) | (F.concat(written, F.lit("\n")) == read_back) | (written == F.concat(read_back, F.lit("\n")))


def lease_seconds(ms: Column) -> Column:
    """Milliseconds as whole seconds, rounded up."""
    return F.ceil(ms / 1000).cast("long")


def inactive(*flags: Column) -> Column:
    """Whether any flag is set; null where all are missing (which a caller refuses)."""
    any_set = F.lit(False)
    for flag in flags:
        any_set |= F.coalesce(flag, F.lit(False))
    return F.when(F.coalesce(*flags).isNotNull(), any_set)
