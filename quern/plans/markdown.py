"""Markdown of the documents' own lines: chunks, titles, sections and references.

Each line's words become one block, of a kind that goes round by the line's number, so
that the oracles know from the numbers alone where headings, sections and links are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import markdown as M
from quern.operators.media import Store, canonical_media
from quern.plans.common import Book
from quern.views import table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def pages(spark, sf_dir) -> DataFrame:
    """(doc_id, text): headings of three levels, quotes, code, lists, underlined headings, elements and links, none of it but headings outside of all else a heading."""
    words = F.filter(F.transform(F.split("text", "\n", -1), lambda s: F.trim(F.regexp_replace(s, "[^A-Za-z]+", " "))), lambda s: s != "")

    def piece(s, i):
        hashes = F.repeat(F.lit("#"), (F.lit(1) + F.floor(i / 9) % 3).cast("int"))
        link = F.concat(F.lit("See ["), s, F.lit("](https://pages.example/"), F.md5(s.cast("binary")), F.lit(") and `[no](https://no.example)`"))
        kinds = [F.concat(hashes, F.lit(" "), s), s, F.concat(F.lit("> # "), s), F.concat(F.lit("```\n# "), s, F.lit("\n\n## x\n```")), F.concat(F.lit("- "), s, F.lit("\n\n  ## inner "), s), F.concat(s, F.lit("\n---")), F.concat(F.lit("    # "), s), F.concat(F.lit("<div>\n\n# "), s, F.lit("\n\n</div>")), link]
        made = kinds[8]
        for k in range(8):
            made = F.when(i % 9 == k, kinds[k]).otherwise(made)
        return F.concat(made, F.lit("\n\n"))

    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.array_join(F.transform(words, piece), ""), F.lit("")).alias("text"))


#: The same pages by line: kind, level and title of headings, the piece and where it begins.
PLACED = r"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL),
  line AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i FROM (SELECT doc_id, p, trim(regexp_replace(l, '[^A-Za-z]+', ' ', 'g')) AS l FROM raw) WHERE l <> ''),
  piece AS (SELECT *, i % 9 AS kind, CASE i % 9 WHEN 0 THEN 1 + (i // 9) % 3 WHEN 5 THEN 2 WHEN 7 THEN 1 END AS level, CASE i % 9
    WHEN 0 THEN repeat('#', CAST(1 + (i // 9) % 3 AS INT)) || ' ' || l WHEN 1 THEN l WHEN 2 THEN '> # ' || l WHEN 3 THEN '```' || chr(10) || '# ' || l || chr(10) || chr(10) || '## x' || chr(10) || '```'
    WHEN 4 THEN '- ' || l || chr(10) || chr(10) || '  ## inner ' || l WHEN 5 THEN l || chr(10) || '---' WHEN 6 THEN '    # ' || l WHEN 7 THEN '<div>' || chr(10) || chr(10) || '# ' || l || chr(10) || chr(10) || '</div>'
    ELSE 'See [' || l || '](https://pages.example/' || md5(l) || ') and `[no](https://no.example)`' END || chr(10) || chr(10) AS said FROM line),
  placed AS (SELECT *, CAST(sum(length(said)) OVER (PARTITION BY doc_id ORDER BY i) - length(said) AS BIGINT) AS off FROM piece),
  whole AS (SELECT doc_id, string_agg(said, '' ORDER BY i) AS page FROM placed GROUP BY doc_id)"""


@BOOK.query("section_level_titles", f"""WITH {PLACED},
  head AS (SELECT *, last_value(CASE WHEN level = 1 THEN l END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 1 THEN off END IGNORE NULLS) OVER w AS p1,
    last_value(CASE WHEN level = 2 THEN l END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN level = 2 THEN off END IGNORE NULLS) OVER w AS p2
    FROM placed WHERE kind IN (0, 5) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))
  SELECT doc_id, off AS start, CAST(level AS INT) AS level, concat_ws(' / ', CASE WHEN level > 1 THEN t1 END, CASE WHEN level > 2 AND p2 > coalesce(p1, -1) THEN t2 END, l) AS path FROM head""")
def section_level_titles(spark, sf_dir):
    """Every heading with the titles above it."""
    paths = M.title_paths(M.headings(pages(spark, sf_dir), "doc_id", "text"), "doc_id")
    return paths.select("doc_id", "start", "level", F.array_join("path", " / ").alias("path"))


@BOOK.query("chunk_markdown")
def chunk_markdown(spark, sf_dir):
    """Every page's chunks; no SQL form (greedy packing), tested by cases and by chunk_tiling."""
    return M.chunks(pages(spark, sf_dir)).select("doc_id", "ordinal", "start", "end", F.array_join("headings", " / ").alias("path"), F.sha2("text", 256).alias("content_sha256"))


@BOOK.query("chunk_tiling", f"""WITH {PLACED}
  SELECT doc_id, CAST(0 AS BIGINT) AS first_start, CAST(sum(length(said)) AS BIGINT) AS last_end, count(*) FILTER (kind IN (0, 5)) AS headings,
    CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS crossing, CAST(0 AS BIGINT) AS oversized, CAST(0 AS BIGINT) AS far_back FROM placed GROUP BY doc_id""")
def chunk_tiling(spark, sf_dir):
    """Whether each page's chunks hold all of it in order, cross no heading, overlap by at most 100 characters and exceed 1,000 only where one block does."""
    inside = lambda a: F.exists(a, lambda p: (p["start"] > F.col("start")) & (p["start"] < F.col("end")))
    rows = M.chunks(pages(spark, sf_dir), target=1000, overlap=100, also=("heads", "tops"))
    # what a row says by itself comes first, so that neither texts nor structures are shuffled
    said = {"crossing": inside("heads"), "oversized": (F.col("end") - F.col("start") > 1000) & inside("tops") & ~F.contains("text", F.lit("<div>"))}
    rows = rows.select("doc_id", "ordinal", "start", "end", F.size("heads").alias("headings"), *[c.alias(n) for n, c in said.items()])
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    counts = {"gaps": F.col("start") > F.col("before"), "crossing": F.col("crossing"), "oversized": F.col("oversized"), "far_back": F.col("before") - F.col("start") > 100}
    return rows.withColumn("before", before).groupBy("doc_id").agg(
        F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.max("headings").cast("long").alias("headings"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in counts.items()]
    )


PLANNED = f"""{PLACED},
  head AS (SELECT doc_id, i, kind, level, l, off + CASE kind WHEN 7 THEN 7 ELSE 0 END AS start FROM placed WHERE level IS NOT NULL),
  edit AS (SELECT doc_id, l, start + length(l) + 3 AS body_start, 'New ' || doc_id || chr(10) AS put FROM head WHERE i = 0),
  same AS (SELECT e.doc_id, count(*) AS n FROM edit e JOIN head h ON h.doc_id = e.doc_id AND h.l = e.l AND h.level = 1 AND h.kind IN (0, 7) GROUP BY e.doc_id),
  bound AS (SELECT e.doc_id, min(h.start) AS body_end FROM edit e JOIN head h ON h.doc_id = e.doc_id AND h.i > 0 AND h.level = 1 GROUP BY e.doc_id),
  planned AS (SELECT doc_id, l, page, put, CASE WHEN length(l) > 200 OR length(page) > 1048576 THEN 'invalid' WHEN n > 1 THEN 'ambiguous' ELSE 'planned' END AS status,
    body_start, coalesce(body_end, length(page)) AS body_end FROM edit JOIN whole USING (doc_id) JOIN same USING (doc_id) LEFT JOIN bound USING (doc_id)),
  plan AS (SELECT *, page[1:body_start] || put || page[body_end + 1:] AS proposed, page[body_start + 1:body_end] AS body FROM planned)"""


def _plans(spark, sf_dir, made):
    heads = M.headings(made, "doc_id", "text").filter("start = 0")
    edits = heads.select("doc_id", "level", F.col("title").alias("heading"), F.concat(F.lit("New "), F.col("doc_id").cast("string"), F.lit("\n")).alias("replacement"))
    return M.plan_sections(made, edits, "doc_id")


@BOOK.query("section_plans", f"""WITH {PLANNED}
  SELECT doc_id, l AS heading, status, CASE WHEN status = 'planned' THEN body_start END AS body_start, CASE WHEN status = 'planned' THEN body_end END AS body_end,
    CASE WHEN status = 'planned' THEN sha256(page) END AS original_sha256, CASE WHEN status = 'planned' THEN sha256(proposed) END AS proposed_sha256 FROM plan""")
def section_plans(spark, sf_dir):
    """The first section of every page replaced: byte range and digests, or why not."""
    return _plans(spark, sf_dir, pages(spark, sf_dir)).drop("level", "proposed")


@BOOK.query("section_updates", f"""WITH {PLANNED},
  fresh AS (SELECT *, page || CASE WHEN doc_id % 3 = 0 THEN 'later' || chr(10) ELSE '' END AS now FROM plan),
  judged AS (SELECT *, CASE WHEN status <> 'planned' THEN status WHEN doc_id % 3 = 0 THEN 'stale' WHEN body = '' THEN 'empty' WHEN length(now) - length(replace(now, body, '')) <> length(body) THEN 'repeated' ELSE 'applied' END AS outcome FROM fresh)
  SELECT doc_id, outcome AS status, sha256(CASE WHEN outcome = 'applied' THEN proposed ELSE now END) AS text_sha256 FROM judged""")
def section_updates(spark, sf_dir):
    """The plans applied to pages of which a third has changed since."""
    made = pages(spark, sf_dir)
    fresh = made.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("later\n"))).otherwise(F.col("text")).alias("text"))
    return M.update_sections(_plans(spark, sf_dir, made), fresh, "doc_id").select("doc_id", "status", F.sha2("text", 256).alias("text_sha256"))


@BOOK.query("reference_rows", f"""WITH {PLACED}
  SELECT doc_id, 'link' AS form, off + 4 AS start, off + length(l) + 62 AS "end", 'https://pages.example/' || md5(l) AS target, TRUE AS supported FROM placed WHERE kind = 8""")
def reference_rows(spark, sf_dir):
    """Every live reference with its byte range."""
    return M.references(pages(spark, sf_dir), "doc_id", "text")


#: An address of the store by page: signed, of one page in three without its date; and what is left of it.
_SIGNED = {
    "base": "'https://files.example.com/' || md5('a' || page_id) || '/' || md5('b' || page_id) || '/' || page_id || '.png'",
    "query": "'?X-Amz-Algorithm=AWS4-HMAC-SHA256&X-Amz-Credential=c' || CASE WHEN page_id % 3 = 0 THEN '' ELSE '&X-Amz-Date=d' END || '&X-Amz-Expires=3600&X-Amz-SignedHeaders=host&X-Amz-Signature=' || page_id || '&x-id=GetObject'",
}
_LIVE = ("![i](", ") and <video src=\"", "\"/>\n\n![b](<", ">)\n\n")
_DEAD = ("`![c](", ")` ![t](", " \"title\") [l](", ")\n\n<pre><image src=\"", "\"/></pre>\n\n```\n![f](", ")\n```\n")


def _said(live: str, dead: str) -> str:
    """The page as SQL, with what stands in live and in dead places."""
    quoted = lambda t: "'" + t.replace("\n", "' || chr(10) || '") + "'"
    return " || ".join([x for piece in _LIVE for x in (quoted(piece), live)][:-1] + [x for piece in _DEAD for x in (quoted(piece), dead)][:-1])


@BOOK.query("media_identities", f"""WITH a AS (SELECT page_id, {_SIGNED['base']} || {_SIGNED['query']} AS u, CASE WHEN page_id % 3 = 0 THEN {_SIGNED['base']} || {_SIGNED['query']} ELSE {_SIGNED['base']} || '?x-id=GetObject' END AS kept FROM pages)
  SELECT page_id, sha256({_said('kept', 'u')}) AS text_sha256 FROM a""")
def media_identities(spark, sf_dir):
    """Every page with images and elements in live and dead places, their addresses signed."""
    signed = table(spark, sf_dir, "pages").select("page_id", F.expr(f"{_SIGNED['base']} || {_SIGNED['query']}").alias("u"))
    made = canonical_media(signed.select("page_id", F.expr(_said("u", "u").replace("chr(10)", "char(10)")).alias("text")), "page_id", "text", Store("files.example.com"))
    return made.select("page_id", F.sha2("text", 256).alias("text_sha256"))
