"""Search, get and related requests end to end, dictionary expansion and write gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.text import snippet
from quern.operators import search as S
from quern.plans.common import Book
from quern.plans.retrieval import LEXICAL
from quern.plans.texts import SIGNED_SQL, signed_url_all
from quern.views import chunks, query_terms, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def dictionary(spark, sf_dir):
    """Edges of a small dictionary: a part's first word to its second."""
    name = F.split("p_name", " ")
    return table(spark, sf_dir, "part").filter("p_name LIKE '% %'").select(F.lower(F.element_at(name, 1)).alias("unit"), F.lower(F.element_at(name, 2)).alias("target")).distinct()


DICTIONARY = """
part_words AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part WHERE p_name LIKE '% %'),
edge AS (SELECT DISTINCT w[1] AS unit, w[2] AS target FROM part_words)"""


@BOOK.query("dictionary_entries", """WITH word AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS h, string_split(lower(p_type), ' ') AS t FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL),
  heads AS (SELECT p_partkey, unnest(h) AS headword FROM word), targets AS (SELECT p_partkey, unnest(t) AS translation FROM word)
  SELECT DISTINCT headword, translation FROM heads JOIN targets USING (p_partkey)""")
def dictionary_entries(spark, sf_dir):
    """Headwords times translations within an entry, each pair once."""
    part = table(spark, sf_dir, "part").filter("p_name IS NOT NULL AND p_type IS NOT NULL")
    heads = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("headword"), "p_type")
    return heads.select("headword", F.explode(F.split(F.lower("p_type"), " ")).alias("translation")).distinct()


@BOOK.query("dictionary_expand", f"""WITH {DICTIONARY},
  asked AS (SELECT unit, min(p_partkey) AS pos FROM (SELECT w[1] AS unit, p_partkey FROM part_words) GROUP BY unit),
  wide AS (SELECT unit, count(*) AS n FROM edge GROUP BY unit),
  turn AS (SELECT a.pos, e.unit, e.target, row_number() OVER (PARTITION BY e.unit ORDER BY e.target) AS i FROM edge e JOIN asked a USING (unit)),
  first AS (SELECT target, i, pos, row_number() OVER (PARTITION BY target ORDER BY i, pos) AS rn FROM turn)
  SELECT target, CAST(i AS BIGINT) AS turn, pos AS unit_pos FROM first WHERE rn = 1 ORDER BY i, pos LIMIT 8""")
def dictionary_expand(spark, sf_dir):
    """Targets of the asked units in turns: every unit's first, then every unit's second; the first place of a target counts, eight at most."""
    asked = table(spark, sf_dir, "part").filter("p_name LIKE '% %'").groupBy(F.lower(F.element_at(F.split("p_name", " "), 1)).alias("unit")).agg(F.min("p_partkey").alias("pos"))
    turn = dictionary(spark, sf_dir).withColumn("turn", F.row_number().over(Window.partitionBy("unit").orderBy("target")).cast("long"))
    best = turn.join(asked, "unit").groupBy("target").agg(F.min(F.struct("turn", "pos")).alias("at"))
    return best.select("target", "at.turn", F.col("at.pos").alias("unit_pos")).orderBy("turn", "unit_pos").limit(8)


@BOOK.query("search_api", rf"""WITH {LEXICAL}, hit AS (SELECT * FROM lexical ORDER BY score DESC, page_id, chunk_id LIMIT 20)
  SELECT hit.chunk_id, hit.page_id, hit.score, substring(regexp_replace(chunk.text, '(?:https?:)?//[^\s)\]>''"]*', '[link omitted]', 'g'), 1, 200) AS snippet FROM hit JOIN chunk USING (chunk_id)""")
def search_api(spark, sf_dir):
    """Validated request, ranked hits, then snippets for those alone."""
    docs = chunks(spark, sf_dir)
    hits = S.lexical(docs, query_terms(spark, sf_dir), S.check_limit(20))
    return docs.select("chunk_id", "text").join(F.broadcast(hits), "chunk_id").select("chunk_id", "page_id", "score", snippet(F.col("text"), 200).alias("snippet"))


BOOK.sql("get_api", """WITH piece AS (SELECT IDIV(doc_id ; 4) AS page_id, doc_id, coalesce(text, '') AS text, coalesce(sum(length(text)) OVER (PARTITION BY IDIV(doc_id ; 4) ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
  SELECT page_id, doc_id, substring(text, 1, CAST(greatest(0, 4000 - before) AS INT)) AS text, before + length(text) > 4000 AS cut FROM piece WHERE before < 4000""")
BOOK.sql("related_api", """WITH edge AS (SELECT DISTINCT o_custkey AS source, l_suppkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  fan AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS turn, count(*) OVER (PARTITION BY source) AS n FROM edge)
  SELECT source, target, n > 20 AS more FROM fan WHERE turn <= 20""")
BOOK.sql("page_properties", """SELECT event_id, event_type AS title, JGET(props ; '$.k') AS k, JGET(props ; '$.missing') IS NULL AS absent, value IS NOT NULL AND value > 0 AS has_number FROM events""")
BOOK.sql("confirmation_gate", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 100000 THEN 'confirm' WHEN o_orderstatus = 'P' THEN 'refuse' ELSE 'allow' END AS decision FROM orders""")


@BOOK.query("signed_url", SIGNED_SQL)
def signed_url(spark, sf_dir):
    """Every page's address, signed, comes back without the signature."""
    return signed_url_all(spark, sf_dir)
