"""Dictionary expansion, ids and references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import links as L
from quern.operators import expansion as X
from quern.operators import markdown as M
from quern.operators import search as S
from quern.plans.common import Book
from quern.plans.retrieval import LEXICAL
from quern.views import chunks, query_terms, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles
HOSTS = ["pages.example.com"]


@BOOK.query("dictionary_plan", """WITH edge AS (SELECT DISTINCT lower(p_name) AS unit, lower(p_brand) AS raw FROM part WHERE p_partkey % 9 = 0),
  named AS (SELECT unit, 'brand ' || chr(97 + CAST(substring(raw, 7) AS INT)) AS target FROM edge), wide AS (SELECT unit, count(*) AS n FROM named GROUP BY unit),
  asked AS (SELECT lower(p_name) AS unit, min(p_partkey) AS pos FROM part WHERE p_partkey < 8 GROUP BY 1),
  turn AS (SELECT a.pos, target, row_number() OVER (PARTITION BY unit ORDER BY target) AS i FROM named JOIN asked a USING (unit) JOIN wide w USING (unit) WHERE w.n <= 4),
  first AS (SELECT target, min(i * 1000 + pos) AS place FROM turn GROUP BY target)
  SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS BIGINT) AS ordinal, target AS phrase FROM first ORDER BY place LIMIT 8""")
def dictionary_plan(spark, sf_dir):
    """Phrases for a query that names eight parts, commas between them: names are units, brands targets."""
    part = table(spark, sf_dir, "part")
    letter = F.chr(F.substring("p_brand", 7, 9).cast("int") + 97)
    edges = part.filter("p_partkey % 9 = 0").select(F.lower("p_name").alias("unit"), F.concat(F.lit("brand "), letter).alias("target"))
    said = part.filter("p_partkey < 8").orderBy("p_partkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"]), ", ").alias("q")).first()[0]
    made = X.plan(said or "", edges)
    return spark.createDataFrame(list(enumerate(made.phrases)), "ordinal long, phrase string")


#: Phrases: neighbours of the query's first three words in any benchmark item that begins with one of them.
EXPANDED = LEXICAL + r""",
words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}]+') AS w FROM benchmark),
edge AS (SELECT DISTINCT w[1] AS unit, w[2] AS target FROM words WHERE len(w) > 2 UNION SELECT DISTINCT w[2], w[3] || ' ' || w[4] FROM words WHERE len(w) > 4),
asked AS (SELECT unnest(w[1:3]) AS unit, generate_subscripts(w[1:3], 1) AS pos FROM words WHERE item_id = 0),
wide AS (SELECT unit, count(*) AS n FROM edge GROUP BY unit),
turn AS (SELECT a.pos, target, row_number() OVER (PARTITION BY unit ORDER BY target) AS i FROM edge JOIN (SELECT unit, min(pos) AS pos FROM asked GROUP BY unit) a USING (unit) JOIN wide w USING (unit) WHERE w.n <= 4),
phrase AS (SELECT target, row_number() OVER (ORDER BY min(i * 1000 + pos)) - 1 AS ordinal FROM turn GROUP BY target QUALIFY row_number() OVER (ORDER BY min(i * 1000 + pos)) <= 8),
spaced AS (SELECT chunk_id, page_id, 'title' AS field, 2 AS band, ' ' || regexp_replace(lower(title), '[^\p{L}\p{N}]+', '  ', 'g') || ' ' AS t FROM chunk UNION ALL SELECT chunk_id, page_id, 'text', 1, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', '  ', 'g') || ' ' FROM chunk),
counted AS (SELECT *, (length(t) - length(replace(t, ' ' || replace(target, ' ', '  ') || ' ', ''))) / CAST(length(target) + 2 + length(target) - length(replace(target, ' ', '')) AS DOUBLE) AS n FROM spaced, phrase),
hit AS (SELECT chunk_id, page_id, score, FALSE AS generated, NULL AS ordinal, field FROM (SELECT * FROM lexical ORDER BY score DESC, page_id, chunk_id LIMIT 20)
  UNION ALL SELECT chunk_id, page_id, round(band + n / (1 + n), 6), TRUE, ordinal, field FROM counted WHERE n > 0),
one AS (SELECT page_id, chunk_id, max(score) AS score, bool_or(NOT generated) AS raw, CAST(count(DISTINCT ordinal) AS BIGINT) AS generated, CAST(min(ordinal) AS BIGINT) AS earliest,
  string_agg(CASE WHEN generated THEN 'g' || ordinal ELSE 'raw' END || '/' || field, ',' ORDER BY generated, ordinal, field) AS evidence FROM hit GROUP BY page_id, chunk_id)"""


@BOOK.query("lexical_expanded", f"WITH {EXPANDED} SELECT page_id, chunk_id, score, raw, generated, earliest, evidence FROM one ORDER BY score DESC, raw DESC, generated, earliest NULLS LAST, page_id, chunk_id LIMIT 50")
def lexical_expanded(spark, sf_dir):
    """The query's own hits and those of a plan's phrases, merged with their evidence."""
    said = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("w"))
    at = lambda k: F.get("w", F.lit(k - 1))
    edges = said.filter(F.size("w") > 2).select(at(1).alias("unit"), at(2).alias("target")).union(said.filter(F.size("w") > 4).select(at(2), F.concat(at(3), F.lit(" "), at(4))))
    asked = said.filter("item_id = 0").select(F.array_join(F.slice("w", 1, 3), " ")).first()
    made = X.plan(asked[0] if asked else "", edges)
    docs = chunks(spark, sf_dir)
    none = F.lit(None).cast("int")
    raw = S.lexical(docs, query_terms(spark, sf_dir), 20)
    hits = raw.select("chunk_id", "page_id", "score", F.struct(F.lit(False).alias("generated"), none.alias("ordinal"), "field").alias("evidence"))
    more = X.phrase_hits(docs, list(made.phrases)) if made.phrases else None
    return X.merged(hits if more is None else hits.unionByName(more), 50)


_MD5 = "md5(url)"
_DASHED = f"substring({_MD5}, 1, 8) || '-' || substring({_MD5}, 9, 4) || '-' || substring({_MD5}, 13, 4) || '-' || substring({_MD5}, 17, 4) || '-' || substring({_MD5}, 21, 12)"


@BOOK.query("page_url_ids", f"SELECT page_id, CASE WHEN page_id % 5 IN (0, 1) THEN {_DASHED} END AS id FROM pages")
def page_url_ids(spark, sf_dir):
    """Ids at the end of a title, dashed ids, and URLs that name none: user information, another host, plain http."""
    md5 = F.md5("url")
    dashed = L.uuid(md5)
    host = F.lit("https://pages.example.com/")
    made = F.when(F.col("page_id") % 5 == 0, F.concat(host, F.lit("ws/Some-Title-"), F.upper(md5), F.lit("?v=1#b"))).when(F.col("page_id") % 5 == 1, F.concat(host, dashed, F.lit("/")))
    made = made.when(F.col("page_id") % 5 == 2, F.concat(F.lit("https://user@pages.example.com/"), md5)).when(F.col("page_id") % 5 == 3, F.concat(F.lit("https://other.example.com/"), md5)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", L.page_id(made, HOSTS).alias("id"))


def _references(spark, sf_dir):
    """Every page's references in order, of a page with dead ones in code, a comment and an escape."""
    host = "https://pages.example.com/"
    address = F.regexp_replace("url", r"([\\<>])", r"\\$1")
    parts = ["[a](<", address, ">) `[x](/code)` ``[y](/code) ` `` \\[no](/escaped) ![i](https://img.example.com/", F.col("page_id").cast("string"), ")\n\n    [in](/indented)\n\n<page url='" + host, F.md5("url"), "'>t</page>\n\n```\n[in](/fence)\n```\n[b](#", F.col("page_id").cast("string"), ") [again][r] <!-- [c](/comment) --> [d](nowhere)\n\n[R]: " + host, F.md5("url"), "\n"]
    said = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = M.references(table(spark, sf_dir, "pages").select("page_id", said.alias("markdown")), "page_id", "markdown")
    return made.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("start")) - 1)


@BOOK.query("markdown_references", f"""SELECT page_id, CAST(pos AS INT) AS pos, form, target FROM (
  SELECT page_id, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest(['link', 'link', 'page', 'link', 'link', 'link']) AS form,
    unnest([url, 'https://img.example.com/' || page_id, 'https://pages.example.com/' || {_MD5}, '#' || page_id, 'https://pages.example.com/' || {_MD5}, 'nowhere']) AS target FROM pages)""")
def markdown_references(spark, sf_dir):
    """Links, images and tags outside code, comments and escapes, in order."""
    return _references(spark, sf_dir).select("page_id", "pos", "form", "target")


@BOOK.query("markdown_relationships", f"""SELECT page_id, {_DASHED} AS identity, 'page' AS kind, CAST(2 AS INT) AS first_pos FROM pages
  UNION ALL SELECT page_id, '#' || page_id, 'block', 3 FROM pages UNION ALL SELECT page_id, sha256('nowhere'), 'invalid', 5 FROM pages""")
def markdown_relationships(spark, sf_dir):
    """Distinct page and block targets by first place; external ones are none, an invalid one is hashed."""
    return L.relationships(_references(spark, sf_dir), "page_id", HOSTS)


@BOOK.query("uuid_forms", """SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) END AS id FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)""")
def uuid_forms(spark, sf_dir):
    """Bare and dashed forms; one with a digit too few is none."""
    h = F.md5("c_name")
    form = F.when(F.col("c_custkey") % 3 == 0, F.upper(h)).when(F.col("c_custkey") % 3 == 1, L.uuid(h)).otherwise(F.left(h, F.lit(31)))
    return table(spark, sf_dir, "customer").select("c_custkey", L.uuid(form).alias("id"))
