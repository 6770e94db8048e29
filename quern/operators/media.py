"""Addresses of stored media without what only grants access to them for a while."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import inline
from quern.functions.blocks import with_blocks
from quern.functions.links import uuid
from quern.operators.markdown import tags_of

#: The fields of a signed request: fixed values of the format; all but the token are needed.
NEEDED = ("X-Amz-Algorithm", "X-Amz-Credential", "X-Amz-Date", "X-Amz-Expires", "X-Amz-SignedHeaders", "X-Amz-Signature")
SIGNING = (*NEEDED, "X-Amz-Security-Token")
ALGORITHM = "AWS4-HMAC-SHA256"
#: Elements that show a file, and those whose content is shown as it stands.
SHOWING, SHOWN = ("image", "file", "pdf", "audio", "video"), ("pre", "code", "script", "style")
EDITS = "array<struct<start:int,end:int,put:string>>"


@dataclass(frozen=True)
class Store:
    """Where media lie: https addresses of ``host`` with a path of two UUIDs and a name."""

    host: str


def identity(address: Column, store: Store, html: bool) -> Column:
    """The address without its signature, everything else as it was; null where it isn't a wholly signed address of the store.

    Wholly signed means each needed field once and not empty. Fields with encoded names,
    and in HTML fields with a bare & among escaped ones, are left alone.
    """
    plain = F.replace(address, F.lit("&amp;"), F.lit("&")) if html else address
    head = F.regexp_extract(plain, rf"(?s)\Ahttps://\Q{store.host}\E/([^?#]*)\?[^#]*", 1)
    parts = F.split(head, "/", -1)
    placed = (F.size(parts) == 3) & uuid(F.get(parts, F.lit(0))).isNotNull() & uuid(F.get(parts, F.lit(1))).isNotNull() & (F.get(parts, F.lit(2)) != "")
    fields = F.split(F.regexp_extract(plain, r"(?s)\A[^?#]*\?([^#]*)", 1), "&", -1)
    of = lambda name: F.filter(fields, lambda f: F.substring_index(f, "=", 1) == name)
    signed = reduce(lambda a, b: a & b, [(F.size(of(n)) == 1) & F.rlike(F.get(of(n), F.lit(0)), F.lit("=.")) for n in NEEDED])
    signed &= F.array_contains(fields, f"X-Amz-Algorithm={ALGORITHM}")
    query = F.regexp_extract(address, r"(?s)\A[^?#]*\?([^#]*)", 1)
    escaped = F.contains(query, F.lit("&amp;")) if html else F.lit(False)
    given = F.when(escaped, F.split(query, "&amp;", -1)).otherwise(F.split(query, "&", -1))
    rest = F.filter(given, lambda f: ~F.substring_index(f, "=", 1).isin(*SIGNING))
    odd = F.exists(rest, lambda f: F.contains(F.substring_index(f, "=", 1), F.lit("%")) | (F.contains(f, F.lit("&")) if html else F.lit(False)))
    kept = F.concat(F.regexp_extract(address, r"(?s)\A[^?#]*", 0), F.when(F.size(rest) > 0, F.concat(F.lit("?"), F.when(escaped, F.array_join(rest, "&amp;")).otherwise(F.array_join(rest, "&")))).otherwise(""), F.regexp_extract(address, r"(?s)(#.*)\z", 1))
    return F.when(placed & signed & ~odd, kept)


def canonical_media(df: DataFrame, key: str, text: str, store: Store) -> DataFrame:
    """(key, text): Markdown whose live images and media elements name files by identity; all other bytes stay.

    Live are images with a plain or bracketed address and no title, and src and source of
    image, file, pdf, audio and video elements; none of it in code, comments, or elements
    that show their content as it stands. Texts without signed addresses come back as
    they are, null ones as null.
    """
    rows = with_blocks(df.filter(F.contains(text, F.lit("X-Amz-"))), key, text)
    rows = rows.withColumn("_tags", F.flatten(F.transform("leaves", tags_of)))
    literal = F.filter("_tags", lambda t: inline.tag_name(t["said"]).isin(*SHOWN))
    rows = rows.withColumn("_literal", inline.paired(literal, F.length(text)))
    live = lambda at: ~F.exists("_literal", lambda s: (at >= s["start"]) & (at < s["end"]))
    shown = F.filter("_tags", lambda t: inline.tag_name(t["said"]).isin(*SHOWING) & ~F.startswith(t["said"], F.lit("</")) & live(t["start"]))

    def element(t: Column) -> Column:
        lead = F.regexp_extract(t["said"], r"""(?s)\A(<[^\s>]+(?:\s+(?!(?:src|source)[\s=])[^\s=>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*\s+(?:src|source)\s*=\s*["'])""", 1)
        value = F.regexp_extract(F.substr(t["said"], F.length(lead) + 1), r"""(?s)\A([^"']*)["']""", 1)
        start = t["start"] + F.length(lead)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), F.when(lead != "", identity(value, store, True)).alias("put"))

    def image(x: Column) -> Column:
        ends = F.when(F.endswith(x["said"], F.lit(">)")), 2).otherwise(1)
        start = x["end"] - ends - F.length(x["target"])
        right = F.endswith(x["said"], F.concat(F.lit("]("), x["target"], F.lit(")"))) | F.endswith(x["said"], F.concat(F.lit("](<"), x["target"], F.lit(">)")))
        return F.struct(start.alias("start"), (x["end"] - ends).alias("end"), F.when(right & (x["form"] == "image") & live(x["start"]), identity(x["target"], store, False)).alias("put"))

    def images(leaf: Column) -> Column:
        tokens = inline.found(leaf["shown"], inline.TOKEN, leaf["start"])
        nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        made = inline.links(tokens, leaf["shown"], leaf["start"], nothing)
        said = F.transform(made, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["form"].alias("form"), x["target"].alias("target"), F.substr(leaf["shown"], x["start"] - leaf["start"] + 1, x["end"] - x["start"]).alias("said")))
        return F.transform(said, image)

    prose = F.filter("leaves", lambda x: x["kind"].isin("paragraph", "heading", "table") & F.contains(x["shown"], F.lit("![")))
    edits = F.array_sort(F.filter(F.concat(F.transform(shown, element), F.flatten(F.transform(prose, images))), lambda e: e["put"].isNotNull()))
    rows = rows.withColumn("_edits", edits)

    def put(acc: Column, e: Column) -> Column:
        fits = e["start"] >= acc["at"]
        said = F.concat(acc["said"], F.substr(F.col(text), acc["at"] + 1, e["start"] - acc["at"]), e["put"])
        return F.struct(F.when(fits, e["end"]).otherwise(acc["at"]).alias("at"), F.when(fits, said).otherwise(acc["said"]).alias("said"))

    done = F.aggregate("_edits", F.struct(F.lit(0).alias("at"), F.lit("").alias("said")), put, lambda acc: F.concat(acc["said"], F.substr(F.col(text), acc["at"] + 1)))
    return rows.select(key, done.alias(text)).unionByName(df.filter(~F.coalesce(F.contains(text, F.lit("X-Amz-")), F.lit(False))).select(key, text))
