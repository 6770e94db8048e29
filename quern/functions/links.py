"""Ids and references in URLs and Markdown, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEX32 = "^[0-9A-Fa-f]{32}$"


def uuid(text: Column) -> Column:
    """32 hexadecimal digits, bare or with the four dashes of a UUID, as a lower-case UUID; null for anything else."""
    bare = F.lower(F.replace(text, F.lit("-"), F.lit("")))
    cut = F.regexp_replace(bare, r"(?s)^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")
    return F.when(F.rlike(text, F.lit("^[0-9A-Fa-f]{32}$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")), cut)


def page_id(url: Column, hosts: list[str]) -> Column:
    """The page that an https URL of an allowed host names by its last path segment or that segment's last 32 characters; null otherwise.

    URLs with user information or a port name none.
    """
    authority = F.regexp_extract(url, r"(?s)\Ahttps://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)\Ahttps://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    tail = F.right(last, F.lit(32))
    return F.when(F.lower(authority).isin(*hosts), F.coalesce(uuid(last), F.when(F.rlike(tail, F.lit(_HEX32)), uuid(tail))))


def target_kind(target: Column, hosts: list[str]) -> Column:
    """block (a page's URL or nothing with a fragment), page, external or invalid."""
    page = page_id(target, hosts)
    fragment = F.regexp_extract(target, r"#(.+)\z", 1)
    kind = F.when(F.startswith(target, F.lit("#")) & (fragment != ""), "block").when(page.isNotNull() & (fragment != ""), "block").when(page.isNotNull() | uuid(target).isNotNull(), "page")
    return kind.when(F.rlike(target, F.lit(r"^https?://[^\s/]+")), "external").otherwise("invalid")


def relationships(references: DataFrame, page: str, hosts: list[str]) -> DataFrame:
    """(page, identity, kind, first_pos): distinct page and block targets of each page, by first place; external ones have none."""
    kind = target_kind(F.col("target"), hosts)
    fragment = F.regexp_extract("target", r"#(.+)\z", 1)
    own = F.coalesce(page_id(F.col("target"), hosts), uuid(F.col("target")), F.lit(""))
    identity = F.when(kind == "invalid", F.sha2("target", 256)).otherwise(F.concat(own, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise("")))
    rows = references.select(page, identity.alias("identity"), kind.alias("kind"), "pos").filter("kind <> 'external'")
    return rows.groupBy(page, "identity", "kind").agg(F.min("pos").alias("first_pos"))
