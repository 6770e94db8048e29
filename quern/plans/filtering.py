"""Filter queries over orders as pages with metadata; the oracles read the orders' own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import filters as Q
from quern.plans.common import Book
from quern.views import metadata, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

_ID = "SELECT CAST(o_orderkey AS VARCHAR) AS page_id FROM orders WHERE"


def _kept(spark, sf_dir, **wanted):
    return metadata(spark, sf_dir).filter(Q.predicate(Q.Filters(**wanted))).select("page_id")


@BOOK.query("filter_id_lists", f"{_ID} o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F', 'O') AND o_custkey % 3 = 0 AND o_custkey % 7 IN (1, 2)")
def filter_id_lists(spark, sf_dir):
    return _kept(spark, sf_dir, root_id=("1-URGENT", "5-LOW"), workspace_id=("F", "O"), database_id=("d1", "d2"))


@BOOK.query("filter_page_kind", f"{_ID} o_custkey % 3 <> 0 AND o_custkey % 5 <> 0")
def filter_page_kind(spark, sf_dir):
    return _kept(spark, sf_dir, kind="standalone")


@BOOK.query("filter_database_kind", f"{_ID} o_custkey % 3 = 0 OR o_custkey % 5 = 0")
def filter_database_kind(spark, sf_dir):
    return _kept(spark, sf_dir, kind="database")


@BOOK.query("filter_edited_range", f"{_ID} o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-06-30 22:00:00'")
def filter_edited_range(spark, sf_dir):
    """Half-open, bounds with offsets or as dates."""
    return _kept(spark, sf_dir, edited=("1996-01-01", "1997-07-01T00:00:00+02:00"))


@BOOK.query("filter_property_equals", f"{_ID} o_orderstatus = 'F' AND o_orderkey % 4 = 0 AND o_orderpriority = '1-URGENT'")
def filter_property_equals(spark, sf_dir):
    """Type and value; an explicit null matches null alone, a missing property nothing."""
    return _kept(spark, sf_dir, properties=(Q.Equals("status", "text", "F"), Q.Equals("note", "null"), Q.Equals("urgent", "flag", True)))


@BOOK.query("filter_property_contains", f"{_ID} o_orderpriority = '3-MEDIUM' AND o_custkey % 10 = 4")
def filter_property_contains(spark, sf_dir):
    return _kept(spark, sf_dir, properties=(Q.Contains("tags", "3-MEDIUM"), Q.Contains("owners", "c4")))


@BOOK.query("filter_property_date", f"{_ID} o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey % 8 <> 7")
def filter_property_date(spark, sf_dir):
    """Dates alone are midnight in UTC; every eighth property has another type and never matches."""
    return _kept(spark, sf_dir, properties=(Q.Dated("due", "1995-03-01T00:00:00Z", "1998-01-01"),))


@BOOK.query("filter_conjunction", f"{_ID} o_orderpriority = '2-HIGH' AND o_custkey % 3 <> 0 AND o_custkey % 5 <> 0 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_totalprice = 200000e0 OR o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey % 3 <> 0 AND o_custkey % 5 <> 0 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderstatus = 'P')")
def filter_conjunction(spark, sf_dir):
    kept = {"root_id": ("2-HIGH",), "kind": "standalone", "edited": ("1995-01-01", None)}
    priced = _kept(spark, sf_dir, **kept, properties=(Q.Equals("price", "number", 200000.0),))
    return priced.union(_kept(spark, sf_dir, **kept, properties=(Q.Contains("tags", "P"),))).distinct()


@BOOK.query("filter_narrowed_roots", f"{_ID} o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED')")
def filter_narrowed_roots(spark, sf_dir):
    """Asked roots that aren't configured add nothing."""
    roots = Q.narrowed_roots(["5-LOW", "1-URGENT", "4-NOT SPECIFIED"], ["4-NOT SPECIFIED", "5-LOW", "3-MEDIUM"])
    return _kept(spark, sf_dir, root_id=tuple(roots))


@BOOK.query("projection_bounded", """SELECT doc_id, left(text, 2000) AS text, coalesce(length(text) > 2000, FALSE) AS overflow, coalesce(contains(lower(text), 'the'), FALSE) AS says_phrase FROM documents""")
def projection_bounded(spark, sf_dir):
    return Q.projected(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 2000, "The")


@BOOK.query("exclusion_reasons", """SELECT c_custkey AS page, CASE WHEN c_custkey IN (1, 4, 9) THEN 'excluded_page' WHEN n_regionkey = 2 OR c_nationkey = 5 THEN 'excluded_descendant' WHEN c_mktsegment = 'MACHINERY' THEN 'excluded_source' END AS reason FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def exclusion_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    above = F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    page = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return rows.select(F.col("c_custkey").alias("page"), Q.exclusion(page, above, F.col("c_mktsegment"), ["c1", "c4", "c9"], ["r2", "n5"], ["MACHINERY"]).alias("reason"))
