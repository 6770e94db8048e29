"""Snapshots of chunks and pages: sinks, differences, identities and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.text import array_digest, domain_digest


class Conflict(ValueError):
    """Data that a sink refuses."""


def compatible(df: DataFrame, expected: StructType) -> DataFrame:
    """df, or Conflict where a column is missing, new or of another type (order and nullability don't matter)."""
    if {(f.name, f.dataType) for f in df.schema} != {(f.name, f.dataType) for f in expected}:
        raise Conflict("the table has another schema")
    return df


def once(df: DataFrame, *key: str) -> DataFrame:
    """df, or Conflict where a key comes twice."""
    if df.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise Conflict("a key comes twice")
    return df


def upserted(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """stored with the batch's rows in place of those of their keys; Conflict where the batch has a key twice."""
    return stored.join(once(compatible(batch, stored.schema), key).hint("merge"), key, "left_anti").select(*stored.columns).unionByName(batch)


def without_pages(stored: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """stored without the rows of the given pages, and of these alone."""
    return stored.join(pages.select(page).distinct().hint("merge"), page, "left_anti").select(*stored.columns)


def pages_merged(stored: DataFrame, snapshot: DataFrame, pages: DataFrame, page: str, key: str) -> DataFrame:
    """stored with each given page's rows replaced by the snapshot's: absent ones go, those of other pages stay."""
    return without_pages(stored, pages, page).unionByName(once(snapshot, key).select(*stored.columns))


def difference(stored: DataFrame, incoming: DataFrame, key: str, same: list[str]) -> DataFrame:
    """(key, action): added, removed, skipped (all of ``same`` equal) or changed."""
    a = stored.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in same])
    b = incoming.select(F.col(key).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in same])
    equal = F.lit(True)
    for c in same:
        equal &= F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    action = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(equal, "skipped").otherwise("changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), action.alias("action"))


def metrics(diff: DataFrame, actions: tuple[str, ...] = ("added", "changed", "skipped", "removed")) -> DataFrame:
    """One row: how many of each action, zeros included."""
    return diff.agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions])


def chunk_id(page: Column, section: Column, content_hash: Column) -> Column:
    return domain_digest("chunk-id", page, section, content_hash)


def identified(drafts: DataFrame, previous: DataFrame) -> DataFrame:
    """(page, section, pos, content_hash, id, how) of every draft.

    drafts: page, section, content_hash, pos; previous: page, section, content_hash, pos,
    id. The nth draft of a hash within its page and section takes the id of the nth stored
    chunk of that hash (kept); where one draft and one stored chunk of a section are left
    over, the draft inherits that id (edited); any other gets a new one (new): the digest
    of page, section and hash, or, where that is in use, with the first of :1, :2, ... that
    isn't. In use are all ids of previous, whether or not their chunks are still there.
    section is a string or an array of strings (a block and the titles above).
    """
    once(previous, "page", "id")
    nth = Window.partitionBy("page", "section", "content_hash").orderBy("pos")
    left = drafts.select("page", "section", "content_hash", "pos").withColumn("nth", F.row_number().over(nth))
    right = previous.withColumn("nth", F.row_number().over(nth)).select("page", "section", "content_hash", "nth", "id")
    met = left.join(right.hint("merge"), ["page", "section", "content_hash", "nth"], "full")
    by = ["page", "section"]
    spare = met.groupBy(*by).agg(F.count_if(F.col("id").isNull()).alias("drafts"), F.count_if(F.col("pos").isNull()).alias("stored"), F.max(F.when(F.col("pos").isNull(), F.col("id"))).alias("left_id"))
    lone = spare.filter("drafts = 1 AND stored = 1").select(*by, "left_id")
    own = met.filter("pos IS NOT NULL").join(lone.hint("merge"), by, "left")
    fresh = F.col("id").isNull() & F.col("left_id").isNull()
    how = F.when(F.col("id").isNotNull(), "kept").when(F.col("left_id").isNotNull(), "edited").otherwise("new")
    array = drafts.schema["section"].dataType.typeName() == "array"
    base = array_digest("chunk-id", F.concat(F.array(F.col("page").cast("string")), F.col("section"), F.array("content_hash"))) if array else chunk_id(F.col("page").cast("string"), F.col("section"), F.col("content_hash"))
    own = own.select(*by, "pos", "content_hash", how.alias("how"), F.coalesce("id", "left_id").alias("id"), F.when(fresh, base).alias("base"))
    # the kth new chunk of a digest takes the kth number that no id in use has: t_j - j numbers are free below the jth in use
    split = r"^(.*?)(?::([1-9][0-9]{0,8}))?$"
    used = previous.select("page", F.regexp_extract("id", split, 1).alias("base"), F.coalesce(F.expr(f"try_cast(regexp_extract(id, r'{split}', 2) AS long)"), F.lit(0)).alias("number"))
    used = used.withColumn("free", F.col("number") - F.row_number().over(Window.partitionBy("page", "base").orderBy("number")) + 1)
    new = own.filter("base IS NOT NULL").withColumn("free", (F.row_number().over(Window.partitionBy("page", "base").orderBy("section", "pos")) - 1).cast("long"))
    both = new.withColumn("in_use", F.lit(0)).unionByName(used.select("page", "base", "free", F.lit(1).alias("in_use")), allowMissingColumns=True)
    upto = Window.partitionBy("page", "base").orderBy("free", F.col("in_use").desc()).rowsBetween(Window.unboundedPreceding, 0)
    numbered = both.withColumn("number", F.col("free") + F.sum("in_use").over(upto)).filter("in_use = 0")
    named = numbered.withColumn("id", F.when(F.col("number") > 0, F.concat("base", F.lit(":"), F.col("number").cast("string"))).otherwise(F.col("base")))
    columns = [*by, "pos", "content_hash", "id", "how"]
    return own.filter("base IS NULL").select(*columns).unionByName(named.select(*columns))


def embedded(incoming: DataFrame, stored: DataFrame, key: str, hash_column: str, vector: str, embed) -> DataFrame:
    """incoming with a vector each: unchanged chunks keep the stored one; embed(DataFrame) adds the column to the others alone."""
    have = stored.select(key, hash_column, vector)
    kept = incoming.join(have.hint("merge"), [key, hash_column]).select(*incoming.columns, vector)
    rest = incoming.join(have.select(key, hash_column).hint("merge"), [key, hash_column], "left_anti").select(*incoming.columns)
    return kept.unionByName(embed(rest))


def inventory(stored: DataFrame, walked: DataFrame) -> DataFrame:
    """(page, class) of two inventories (page, parent, body, trashed): removed, trashed, added, changed, moved or same, in this order."""
    a = stored.select(F.col("page").alias("_a"), F.col("parent").alias("_ap"), F.col("body").alias("_ab"))
    b = walked.select(F.col("page").alias("_b"), F.col("parent").alias("_bp"), F.col("body").alias("_bb"), "trashed")
    kind = F.when(F.col("_b").isNull(), "removed").when(F.col("trashed"), "trashed").when(F.col("_a").isNull(), "added")
    kind = kind.when(~F.col("_ab").eqNullSafe(F.col("_bb")), "changed").when(~F.col("_ap").eqNullSafe(F.col("_bp")), "moved").otherwise("same")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias("page"), kind.alias("class"))


def removals_held(gone: DataFrame, before: DataFrame, lineage: DataFrame) -> DataFrame:
    """(page, state) of unreached pages.

    before: page, outcome of the last walk; lineage: page, ancestor. A page below an
    ancestor that has only now become inaccessible is held; one whose inaccessible ancestor
    was so in the last walk already, or that has none, is removed.
    """
    state = gone.join(lineage.hint("merge"), "page", "left").join(before.select(F.col("page").alias("ancestor"), "outcome").hint("merge"), "ancestor", "left")
    fresh = F.coalesce((F.col("outcome") == "readable"), F.lit(False))
    return state.groupBy("page").agg(F.when(F.max(fresh), "held").otherwise("removed").alias("state"))


def synced(stored: DataFrame, hits: DataFrame, key: str, complete: bool, walk) -> DataFrame:
    """Incremental sync: the hits since the high-water mark are upserted; where the listing was cut short, walk() gives the whole instead."""
    return upserted(stored, hits, key) if complete else walk()


def changed_since(rows: DataFrame, edited: str, since: Column, most: int | None = None) -> tuple[DataFrame, bool]:
    """Rows edited at or after ``since``, newest first, and whether all are there."""
    found = rows.filter(F.col(edited) >= since).orderBy(F.desc(edited))
    if most is None:
        return found, True
    return found.limit(most), found.limit(most + 1).count() <= most


def pages_after(rows: DataFrame, sequence: str, after: int, limit: int) -> DataFrame:
    """One page of a keyset listing."""
    return rows.filter(F.col(sequence) > after).orderBy(sequence).limit(limit)


def same_candidates(a: DataFrame, b: DataFrame) -> bool:
    """Whether two rankings hold the same rows, in any order."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
