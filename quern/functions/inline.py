"""Inline markup of Markdown as Column expressions: matches with offsets, code, tags, links.

Offsets count code points. A match's place comes from the pieces between matches, which
are added up; no text is walked character by character outside the regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<start:int,end:int,said:string>>"
#: Matches that are added up before their list is appended to the result.
STEP = 128


def found(text: Column, pattern: str, base: Column | int = 0) -> Column:
    """array<struct<start, end, said>> of all matches, left to right; null texts have none."""
    said, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(FOUND)

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        end = start + F.length(x["said"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["said"].alias("said")))).alias("out"))

    def some(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(acc["pieces"], k * STEP + 1, F.lit(STEP)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], part["out"]).alias("out"), acc["pieces"].alias("pieces"))

    # the last piece has no match after it
    pieces = F.zip_with(gaps, said, lambda g, s: F.struct(F.length(g).alias("skip"), s.alias("said")))
    start = F.struct(F.lit(base).cast("int").alias("at") if isinstance(base, int) else base.cast("int").alias("at"), none.alias("out"), F.filter(pieces, lambda x: x["said"].isNotNull()).alias("pieces"))
    many = F.sequence(F.lit(0), F.floor((F.size(said) - 1) / STEP).cast("int"))
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(many, start, some)["out"]).otherwise(none)


ESCAPE = r"\\[!-/:-@\[-`{-~]"
CODE = r"(`++)(?:[^`]++|(?!\1(?!`))`++)*+\1(?!`)"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++)"""
TAG = rf"</?[A-Za-z][A-Za-z0-9-]*+(?:\s++[A-Za-z_:][A-Za-z0-9_.:-]*+(?:\s*+=\s*+{_VALUE})?+)*+\s*+/?>"
LITERAL = r"<!--(?s:.*?)(?:-->|\z)|<!\[CDATA\[(?s:.*?)(?:\]\]>|\z)|<\?(?s:.*?)(?:\?>|\z)"
AUTOLINK = r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*+>"
_TITLE = r"""(?:"(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+'|\((?:\\.|[^()\\])*+\))"""
_DESTINATION = r"(?:<(?:\\.|[^<>\n\\])*+>|(?:\\.|[^\s()\\<]|\((?:\\.|[^\s()\\])*+\))*+)"
CLOSE = rf"\](?:\(\s*+{_DESTINATION}(?:\s++{_TITLE})?+\s*+\)|\[(?:\\.|[^\[\]\\])*+\])?+"
#: Everything that a scan from left to right steps over as one, code before tags and tags before brackets.
TOKEN = rf"{ESCAPE}|{CODE}|`++|{AUTOLINK}|{LITERAL}|{TAG}|!?\[|{CLOSE}"
#: The same without brackets, for HTML.
MARKUP = rf"{ESCAPE}|{CODE}|`++|{AUTOLINK}|{LITERAL}|{TAG}"
#: Inside an HTML block there is no Markdown.
IN_HTML = rf"{LITERAL}|{TAG}"
DEFINITION = rf"(?:\A|(?<=\n))\x20{{0,3}}\[(?:\\.|[^\[\]\\])++\]:\s*+(?:<(?:\\.|[^<>\n\\])*+>|[^\s<]\S*+)(?:\s++{_TITLE})?+[\x20\t]*+(?:\n|\z)"
RAW = ("script", "style", "textarea", "title")
#: Elements without content: fixed values of HTML.
VOID = ("br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "embed", "source", "track", "col", "param")


def tag_name(said: Column) -> Column:
    return F.lower(F.regexp_extract(said, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))


def paired(tags: Column, size: Column) -> Column:
    """array<struct<start, end, alone>> of HTML elements, from tags array<struct<start, end, said, alone>> in order.

    A stack of open elements: an end tag closes the top if it has its name and does nothing
    otherwise; inside script, style, textarea and title only their own end tag counts. What
    is never closed reaches to the text's end.
    """
    open_type, span_type = "array<struct<name:string,start:int,alone:boolean>>", "array<struct<start:int,end:int,alone:boolean>>"

    def step(acc: Column, t: Column) -> Column:
        name, top = tag_name(t["said"]), F.try_element_at(acc["open"], F.lit(-1))
        closes = F.startswith(t["said"], F.lit("</"))
        raw = F.coalesce(top["name"].isin(*RAW), F.lit(False)) & ~(closes & (top["name"] == name))
        matched = closes & F.coalesce(top["name"] == name, F.lit(False))
        opens = ~closes & (name != "") & ~F.endswith(t["said"], F.lit("/>")) & ~name.isin(*VOID)
        span = F.struct(top["start"].alias("start"), t["end"].alias("end"), top["alone"].alias("alone"))
        pushed = F.concat(acc["open"], F.array(F.struct(name.alias("name"), t["start"].alias("start"), t["alone"].alias("alone"))))
        return F.struct(
            F.when(raw, acc["open"]).when(matched, F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1)).when(opens, pushed).otherwise(acc["open"]).alias("open"),
            F.when(~raw & matched, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    done = F.aggregate(tags, F.struct(F.array().cast(open_type).alias("open"), F.array().cast(span_type).alias("spans")), step)
    tails = F.transform(done["open"], lambda o: F.struct(o["start"].alias("start"), size.alias("end"), F.lit(False).alias("alone")))
    return F.concat(done["spans"], tails)


def label(text: Column) -> Column:
    """A reference label as it is compared."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def definitions(shown: Column) -> Column:
    """map of label to target of the definitions that a paragraph begins with; the first of a label counts."""
    said = F.regexp_extract_all(F.regexp_extract(shown, rf"\A(?:{DEFINITION})++", 0), F.lit(DEFINITION), F.lit(0))
    pairs = F.transform(said, lambda d: F.struct(label(F.regexp_extract(d, r"\[((?:\\.|[^\[\]\\])++)\]:", 1)).alias("key"), target(F.regexp_extract(d, r"\]:\s*+(<(?:\\.|[^<>\n\\])*+>|\S++)", 1)).alias("value")))
    return pairs


def target(said: Column) -> Column:
    """A link destination without angle brackets and escapes."""
    bare = F.regexp_replace(said, r"(?s)\A<(.*)>\z", "$1")
    return F.regexp_replace(bare, r"\\([!-/:-@\[-`{-~])", "$1")


LINKS = "array<struct<start:int,end:int,form:string,target:string>>"


def links(tokens: Column, text: Column, base: Column, known: Column) -> Column:
    """array<struct<start, end, form, target>> of links, images and autolinks, from TOKEN matches of a leaf.

    A stack of brackets: an end bracket takes the last open one, and is a link if it has a
    target or a label that ``known`` (map) has. No link lies in another link; images may.
    """
    open_type = "array<struct<start:int,end:int,image:boolean,dead:boolean>>"

    def step(acc: Column, t: Column) -> Column:
        said = t["said"]
        opens, closes = said.isin("[", "!["), F.startswith(said, F.lit("]"))
        top = F.try_element_at(acc["open"], F.lit(-1))
        rest = F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1)
        inside = F.substr(text, top["end"] - base + 1, t["start"] - top["end"])
        named = F.regexp_extract(said, r"^\]\[((?s:.+))\]$", 1)
        inline = F.regexp_extract(said, rf"^\]\(\s*+({_DESTINATION})(?:\s++{_TITLE})?+\s*+\)$", 1)
        to = F.when(F.startswith(said, F.lit("](")), target(inline)).otherwise(F.try_element_at(known, label(F.when(named != "", named).otherwise(inside))))
        hit = closes & top.isNotNull() & ~top["dead"] & to.isNotNull()
        auto = F.rlike(said, F.lit(rf"^{AUTOLINK}$"))
        link = F.struct(F.when(auto, t["start"]).otherwise(top["start"]).alias("start"), t["end"].alias("end"), F.when(auto | ~top["image"], "link").otherwise("image").alias("form"), F.when(auto, F.substr(said, F.lit(2), F.length(said) - 2)).otherwise(to).alias("target"))
        dead = F.transform(rest, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), o["image"].alias("image"), (o["dead"] | ~o["image"]).alias("dead")))
        opened = F.struct(t["start"].alias("start"), t["end"].alias("end"), (said == "![").alias("image"), F.lit(False).alias("dead"))
        return F.struct(
            F.when(opens, F.concat(acc["open"], F.array(opened))).when(closes & top.isNotNull(), F.when(hit & ~top["image"], dead).otherwise(rest)).otherwise(acc["open"]).alias("open"),
            F.when(F.coalesce(hit, F.lit(False)) | auto, F.concat(acc["out"], F.array(link))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(tokens, F.struct(F.array().cast(open_type).alias("open"), F.array().cast(LINKS).alias("out")), step)["out"]


def plain(said: Column) -> Column:
    """A heading's title without its marks: links and images by their text, emphasis, code and tags by what they hold."""
    bare = F.regexp_replace(F.regexp_replace(said, r"(?s)\A#{1,6}(?:[\x20\t]+|(?=\n|\z))", ""), r"(?:\A|[\x20\t]+)#+[\x20\t]*\r?\n?\z|\s+(?:=+|-+)[\x20\t]*\r?\n?\z", "")
    text = F.regexp_replace(F.regexp_replace(bare, rf"!?\[([^\[\]]*)\](?:\({_DESTINATION}(?:\s++{_TITLE})?+\))", "$1"), TAG, "")
    text = F.regexp_replace(F.regexp_replace(text, r"(`+)\x20?((?s:.*?))\x20?\1", "$2"), r"(\*{1,3}|~~)(?=\S)((?s:.*?\S))\1", "$2")
    text = F.regexp_replace(F.regexp_replace(text, r"(?<![\p{L}\p{N}])(_{1,3})(?=\S)((?s:.*?\S))\1(?![\p{L}\p{N}])", "$2"), r"\\([!-/:-@\[-`{-~])", "$1")
    return F.trim(F.regexp_replace(text, r"\s*\n\s*", " "))
