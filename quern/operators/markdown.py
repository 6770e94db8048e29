"""Markdown as rows: blocks, chunks, title paths, sections and references.

A text is scanned once per row (functions/blocks.py); everything after that is Column
expressions over its leaves, windows and joins. Nothing is shuffled but by the windows and
joins that say so. Null and empty texts give no rows; repeated keys are texts of their own
for chunks and references, and one text for title paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import inline
from quern.functions.blocks import with_blocks

_INLINE = ("paragraph", "heading", "table")
#: A paragraph with none of these can be cut at white space without making other Markdown of it.
_MARKED = r"[*_`\[\]<>\\&!~\-+#=|\t]|\x20\x20|(?:\A|\s)[0-9]+[.)](?:\s|\z)"


def held(df: DataFrame, name: str, made: Column) -> DataFrame:
    """df with a column that is reckoned once a row.

    The optimizer puts a plain column's expression wherever it is used: into lambdas, once
    for each of their elements, and into the filter that it adds before an explode. It does
    neither with what a generator gives.
    """
    return df.select("*", F.explode(F.array(made)).alias(name))


def tags_of(leaf: Column) -> Column:
    """HTML tags of a leaf, with whether they stand outside of containers."""
    said = F.when(leaf["kind"] == "html", inline.found(leaf["shown"], inline.IN_HTML, leaf["start"])).when(
        leaf["kind"].isin(*_INLINE) & F.contains(leaf["shown"], F.lit("<")), F.filter(inline.found(leaf["shown"], inline.MARKUP, leaf["start"]), lambda t: F.startswith(t["said"], F.lit("<")))
    )
    return F.transform(F.coalesce(said, F.array().cast(inline.FOUND)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["said"].alias("said"), (leaf["depth"] == 0).alias("alone")))


def structure(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, tops, leaves, spans, heads): spans are whole HTML elements, heads the headings outside of containers and elements, with their titles."""
    made = held(with_blocks(df, key, text), "tags", F.flatten(F.transform("leaves", tags_of)))
    made = held(made, "spans", F.when(F.size("tags") > 0, inline.paired(F.col("tags"), F.length(text))).otherwise(F.array().cast("array<struct<start:int,end:int,alone:boolean>>")))
    outer = F.filter("leaves", lambda x: (x["kind"] == "heading") & (x["depth"] == 0))
    free = F.filter(outer, lambda x: ~F.exists("spans", lambda s: (x["start"] >= s["start"]) & (x["start"] < s["end"])))
    heads = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["level"].alias("level"), inline.plain(x["shown"]).alias("title")))
    return held(made, "heads", heads).drop("tags")


def _points(text: str, target: int, overlap: int) -> Column:
    """Where a chunk may begin: at blocks, at white space of plain prose, and at lines that whole HTML elements have to themselves."""
    every = max(1, min(target // 2, overlap // 2 if overlap else target))
    prose = F.filter("leaves", lambda x: (x["kind"] == "paragraph") & (x["depth"] == 0) & (F.length(x["shown"]) > every) & ~F.rlike(x["shown"], F.lit(_MARKED)))
    cuts = F.flatten(F.transform(prose, lambda x: F.transform(inline.found(x["shown"], rf"(?s).{{{every - 1},}}?\s", x["start"]), lambda m: m["end"])))

    def line(s: Column) -> Column:
        before = F.substring_index(F.left(text, s["start"]), "\n", -1)
        after = F.substring_index(F.substr(F.col(text), s["end"] + 1), "\n", 1)
        return F.when(s["alone"] & (F.trim(before) == "") & (F.trim(after) == ""), s["start"] - F.length(before))

    lines = F.filter(F.transform("spans", line), lambda p: p.isNotNull())
    points = F.concat(F.transform("tops", lambda t: t["start"]), cuts, lines)
    free = F.filter(points, lambda p: ~F.exists("spans", lambda s: (p > s["start"]) & (p < s["end"])))
    return F.array_sort(F.array_distinct(free))


def packed(points: list[int], start: int, end: int, target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Greedy slices of [start, end) between points: as many blocks as fit, then again from the last blocks within the overlap."""
    points = [start, *(p for p in points if start < p < end), end]
    first = 0
    while first + 1 < len(points):
        last = first + 1
        while last + 1 < len(points) and points[last + 1] - points[first] <= target:
            last += 1
        yield points[first], points[last]
        if last + 1 == len(points):
            return
        again = last
        while again > first + 1 and points[last] - points[again - 1] <= overlap:
            again -= 1
        first = again


#: Any character but white space.
_SOLID = r"[^\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PACK = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("path", pa.list_(pa.string()))]))


def _packer(target: int, overlap: int):
    """points, heads, length -> start, end and titles of each slice; texts themselves don't go to Python for it."""

    def sliced(points: list[int], heads: list[dict], size: int) -> list[dict]:
        path: list[tuple[int, str]] = []
        start, out = 0, []
        for head in [*heads, None] if size else []:
            end = head["start"] if head else size
            if start < end:
                titles = [t for _, t in path]
                out += [{"start": a, "end": b, "path": titles} for a, b in packed(points, start, end, target, overlap)]
            if head:
                path = [p for p in path if p[0] < head["level"]] + [(head["level"], head["title"])]
                start = end
        return out

    @F.arrow_udf("array<struct<start:int,end:int,path:array<string>>>")
    def cut(points: pa.Array, heads: pa.Array, size: pa.Array) -> pa.Array:
        made = []
        for at in range(0, len(size), 64):
            rows = zip(*(c.slice(at, 64) for c in (points, heads, size)), strict=True)
            made.append(pa.array([sliced(p.as_py(), h.as_py(), n.as_py() or 0) for p, h, n in rows], _PACK))
        return pa.concat_arrays(made) if made else pa.array([], _PACK)

    # so that it is reckoned once, not again in the filter that the optimizer adds before an explode
    return cut.asNondeterministic()


def chunks(df: DataFrame, key: str = "doc_id", text: str = "text", target: int = 2000, overlap: int = 200, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, ordinal, start, end, headings, text) of every chunk, and the columns of structure() named by ``also``.

    Chunks are slices between block starts; lists, quotes, code, tables and HTML elements
    stay whole, even over the target. They cross no heading, overlap by whole blocks of at
    most ``overlap`` characters, and together hold every character but blank sections.
    """
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("the target must be over 0 and over the overlap")
    made = held(structure(df, key, text), "_points", _points(text, target, overlap)).select(key, text, "_points", *dict.fromkeys(["heads", *also]))
    made = made.withColumn("_packs", _packer(target, overlap)("_points", "heads", F.length(text)))
    said = F.transform("_packs", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["path"].alias("headings"), F.substr(F.col(text), p["start"] + 1, p["end"] - p["start"]).alias("text")))
    made = held(made, "_rows", F.filter(said, lambda c: F.rlike(c["text"], F.lit(_SOLID))))
    rows = made.select(key, *also, F.posexplode("_rows").alias("ordinal", "_c"))
    place = [F.col(n).cast("long").alias(n.removeprefix("_c.")) for n in ("ordinal", "_c.start", "_c.end")]
    return rows.select(key, *place, "_c.headings", "_c.text", *also)


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, level, title) of the headings outside of containers."""
    return structure(df, key, text).select(key, F.explode("heads").alias("h")).select(key, F.col("h.start").cast("long").alias("start"), "h.level", "h.title")


def title_paths(heads: DataFrame, key: str) -> DataFrame:
    """heads (key, start, level, title) with ``path``: the titles above and its own.

    Per level the last title is carried forward, and dropped as soon as a heading of a
    higher level came after it.
    """
    so_far = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda n, c: F.last(F.when(F.col("level") == n, c), ignorenulls=True).over(so_far)
    above = lambda n: F.max(F.when(F.col("level") < n, F.col("start"))).over(so_far)
    alive = [F.when((F.col("level") >= n) & (of(n, F.col("start")) > F.coalesce(above(n), F.lit(-1))), of(n, F.col("title"))) for n in range(1, 7)]
    return heads.withColumn("path", F.filter(F.array(*alive), lambda t: t.isNotNull()))


#: Markup that a section's body must not lose.
_KEPT_TAGS = ("<unknown", "<page ", "<database ", "<data-source ")
MOST_PAGE, MOST_BODY, MOST_ANCHOR = 1 << 20, 200_000, 200


def plan_sections(pages: DataFrame, edits: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, level, heading, status, body_start, body_end, original_sha256, proposed_sha256, proposed): what each edit would do.

    edits are (key, level, heading, replacement). status: planned, invalid (the anchor, a
    size, or a last line that would run into the next heading), missing, ambiguous,
    unsupported (markup that would be lost, a heading that would leave the section, a
    heading without a line of its own) or unchanged. Only planned ones have the rest: the
    body's byte range, digests of the page before and after, and the page after. The
    anchor is a whole line ``## heading`` outside of all containers; the body ends before
    the next such heading of its level or a higher one. An edit of no page is missing.
    """
    page = with_blocks(pages, key, text)
    heads = F.filter("leaves", lambda x: (x["kind"] == "heading") & F.exists("tops", lambda t: (t["start"] == x["start"]) & (t["kind"] == "heading")))
    page = page.select(key, F.col(text).alias("_page"), F.transform(heads, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["level"].alias("level"), x["shown"].alias("shown"))).alias("_heads"))
    new = with_blocks(edits.select(F.struct(key, "level", F.coalesce("heading", F.lit("")).alias("heading")).alias("_edit"), F.coalesce("replacement", F.lit("")).alias("_put")), "_edit", "_put")
    least = F.array_min(F.transform(F.filter("leaves", lambda x: x["kind"] == "heading"), lambda x: x["level"]))
    asked = new.select("_edit.*", "_put", least.alias("_least")).join(page, key, "left")
    line = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "heading")
    asked = held(asked, "_same", F.filter("_heads", lambda h: (h["level"] == F.col("level")) & (F.regexp_replace(h["shown"], r"\r?\n\z", "") == line)))
    at = F.try_element_at("_same", F.lit(1))
    later = F.filter("_heads", lambda h: (h["start"] > at["start"]) & (h["level"] <= F.col("level")))
    asked = asked.withColumn("_from", at["end"]).withColumn("_to", F.coalesce(F.array_min(F.transform(later, lambda h: h["start"])), F.length("_page")))
    put, before = F.col("_put"), F.left("_page", F.col("_from"))
    asked = asked.withColumn("_body", F.substr("_page", F.col("_from") + 1, F.col("_to") - F.col("_from")))
    asked = asked.withColumn("proposed", F.concat(before, put, F.substr(F.col("_page"), F.col("_to") + 1)))
    bad_anchor = ~F.coalesce(F.col("level").between(1, 6), F.lit(False)) | (F.col("heading") == "") | (F.length("heading") > MOST_ANCHOR) | F.rlike("heading", F.lit(r"\A\s|\s\z|\p{Cntrl}|[<>`]|\A#"))
    bad_size = (F.coalesce(F.octet_length("_page"), F.lit(0)) > MOST_PAGE) | (F.octet_length(put) > MOST_BODY) | F.contains(put, F.lit("\x00"))
    lost = reduce(lambda a, b: a | b, [F.contains("_body", F.lit(t)) for t in _KEPT_TAGS])
    status = (
        F.when(bad_anchor | bad_size, "invalid")
        .when(F.coalesce(F.size("_same"), F.lit(0)) <= 0, "missing")
        .when(F.size("_same") > 1, "ambiguous")
        .when((F.col("_from") == F.length("_page")) & ~F.endswith("_page", F.lit("\n")) & (put != ""), "unsupported")
        .when(lost, "unsupported")
        .when((F.col("_to") < F.length("_page")) & (put != "") & ~F.endswith(put, F.lit("\n")), "invalid")
        .when(F.col("_body") == put, "unchanged")
        .when(F.coalesce(F.col("_least") <= F.col("level"), F.lit(False)), "unsupported")
        .when(F.octet_length("proposed") > MOST_PAGE, "invalid")
        .otherwise("planned")
    )
    asked = asked.withColumn("status", status)
    only = lambda c: F.when(F.col("status") == "planned", c)
    start = F.octet_length(before).cast("long")
    return asked.select(
        key, "level", "heading", "status",
        only(start).alias("body_start"), only(start + F.octet_length("_body")).alias("body_end"),
        only(F.sha2("_page", 256)).alias("original_sha256"), only(F.sha2("proposed", 256)).alias("proposed_sha256"),
        only(F.col("proposed")).alias("proposed"),
    )


def update_sections(plans: DataFrame, fresh: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, level, heading, status, text): planned edits against freshly read pages (key, text).

    A body must be there and stand in the page once. status: applied, stale (the page is
    not, byte for byte, the one that was planned on), empty or repeated (the old body), or
    the plan's own. text is the page that holds afterwards, the fresh one unless applied.
    Two edits of one page don't both apply: the second is stale once the first is stored.
    """
    now = plans.join(fresh.select(key, F.col(text).alias("_now")), key, "left")
    size = F.octet_length("_now")
    body = F.decode(F.substr(F.encode("_now", "UTF-8"), (F.col("body_start") + 1).cast("int"), (F.col("body_end") - F.col("body_start")).cast("int")), "UTF-8")
    same = F.coalesce(F.sha2("_now", 256) == F.col("original_sha256"), F.lit(False))
    once = (size - F.octet_length(F.replace(F.col("_now"), body, F.lit("")))) == F.octet_length(body)
    status = F.when(F.col("status") != "planned", F.col("status")).when(~same, "stale").when(F.col("body_start") == F.col("body_end"), "empty").when(~once, "repeated").otherwise("applied")
    made = now.withColumn("status", status)
    return made.select(key, "level", "heading", "status", F.when(F.col("status") == "applied", F.col("proposed")).otherwise(F.col("_now")).alias("text"))


_WRAPPED = re.compile(
    r"(?P<keep>^[ \t]*(?P<fence>`{3,}|~{3,})[^\n]*\n(?:.*\n)*?[ \t]*(?P=fence)[`~]*[ \t]*$|(?<!`)(?P<ticks>`+)(?!`)[^\n]*?(?<!`)(?P=ticks)(?!`)|\]\(\s*<(?:\\.|[^<>\n\\])*>)"
    r"|(?P<note><!--(?s:.*?)(?:-->|\Z))"
    r"""|(?P<tag></?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*\s*/?>)""",
    re.M,
)
_BLANK = re.compile(r"[^\n]")
_TABS = re.compile(r"^\t+", re.M)


def unwrapped(text: str) -> str:
    """The text, as long as it was, with what wraps other Markdown out of the way: comments blank, tags as one letter and blanks, leading tabs as quote marks."""

    def put(m: re.Match) -> str:
        if m["keep"]:
            return m[0]
        return _BLANK.sub(" ", m[0]) if m["note"] else "x" + _BLANK.sub(" ", m[0][1:])

    return _TABS.sub(lambda m: ">" * len(m[0]), _WRAPPED.sub(put, text))


_NAMED = rf"{inline.ESCAPE}|<(?:page|database|mention-[A-Za-z-]*+)(?=[\s/>])(?:\"[^\"\n]*+\"|'[^'\n]*+'|[^'\">\n])*+(?:>|[^\n]*+)"
_ATTRIBUTES = r"""\A<[A-Za-z-]++(?:\s++[A-Za-z_:][A-Za-z0-9_.:-]*+\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))*+\s*+/?>\z"""
_URL = r"""\surl\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, start, end, target, supported) of every link, image, autolink and page tag that is live; byte offsets into the text.

    form: link (images and autolinks too) or the tag's name (page, database, mention-...).
    Code of any kind, comments and escaped marks hold none. Links by label take their
    target from the text's definitions. A tag without a readable url has its own source as
    target; only page and mention-page are supported, and mention-date is no reference.
    """
    made = with_blocks(df, key, text, unwrapped)
    pairs = F.flatten(F.transform(F.filter("leaves", lambda x: (x["kind"] == "paragraph") & F.contains(x["shown"], F.lit("]:"))), lambda x: inline.definitions(x["shown"])))
    made = held(made, "_pairs", pairs)
    first = F.filter("_pairs", lambda p, i: ~F.exists(F.slice("_pairs", F.lit(1), i), lambda q: q["key"] == p["key"]))
    made = held(made, "_known", F.map_from_entries(first))

    def body(x: Column) -> Column:
        lead = F.when(F.contains(x["shown"], F.lit("]:")), F.length(F.regexp_extract(x["shown"], rf"\A(?:{inline.DEFINITION})++", 0))).otherwise(0)
        return F.concat(F.repeat(F.lit(" "), lead), F.substr(x["shown"], lead + 1))

    shown = F.transform(F.filter("leaves", lambda x: x["kind"].isin(*_INLINE)), lambda x: F.struct(x["start"].alias("start"), body(x).alias("shown")))
    made = made.withColumn("_shown", shown)
    made = held(made, "_tokens", F.transform("_shown", lambda x: F.struct(x["start"].alias("start"), x["shown"].alias("shown"), F.when(F.rlike(x["shown"], F.lit(r"[`\[<]")), inline.found(x["shown"], inline.TOKEN, x["start"])).otherwise(F.array().cast(inline.FOUND)).alias("tokens"))))
    links = F.flatten(F.transform("_tokens", lambda x: inline.links(x["tokens"], x["shown"], x["start"], F.col("_known"))))
    spans = F.flatten(F.transform("_tokens", lambda x: F.filter(x["tokens"], lambda t: F.startswith(t["said"], F.lit("`")) & F.rlike(t["said"], F.lit(rf"\A{inline.CODE}\z")))))
    blocks = F.transform(F.filter("leaves", lambda x: x["kind"] == "code"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    notes = F.when(F.contains(text, F.lit("<!--")), F.filter(inline.found(F.col(text), inline.LITERAL), lambda t: F.startswith(t["said"], F.lit("<!--")))).otherwise(F.array().cast(inline.FOUND))
    made = held(made.withColumn("_links", links), "_code", F.concat(blocks, *[F.transform(a, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))) for a in (spans, notes)]))
    tags = F.filter(inline.found(F.col(text), _NAMED), lambda t: F.startswith(t["said"], F.lit("<")) & ~F.startswith(t["said"], F.lit("<mention-date")))
    tags = F.filter(tags, lambda t: ~F.exists("_code", lambda c: (c["start"] <= t["start"]) & (t["start"] < c["end"])))

    def named(t: Column) -> Column:
        name, url = F.regexp_extract(t["said"], r"^<([A-Za-z-]+)", 1), F.concat(F.regexp_extract(t["said"], _URL, 1), F.regexp_extract(t["said"], _URL, 2))
        good = F.rlike(t["said"], F.lit(_ATTRIBUTES)) & (url != "")
        plain = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")], url)
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), name.alias("form"), F.when(good, plain).otherwise(t["said"]).alias("target"), name.isin("page", "mention-page").alias("supported"))

    every = F.concat(F.transform("_links", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("link").alias("form"), x["target"].alias("target"), F.lit(True).alias("supported"))), F.transform(tags, named))
    rows = held(made, "_every", F.array_sort(every)).select(key, text, F.explode("_every").alias("r"))
    to = lambda c: F.octet_length(F.left(text, c)).cast("long")
    return rows.select(key, F.col("r.form").alias("form"), to(F.col("r.start")).alias("start"), to(F.col("r.end")).alias("end"), F.col("r.target").alias("target"), F.col("r.supported").alias("supported"))
