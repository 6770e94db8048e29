"""Hierarchy, scope and link queries: a tree of customers below nations and regions, pages' links, edges from lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import hierarchy as H
from quern.plans.common import Book
from quern.views import table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

TREE = """
node AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR(20)) AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"""
WALK = f"""RECURSIVE {TREE},
up AS (
  SELECT id, id AS anc, parent, 0 AS depth FROM node
  UNION ALL SELECT u.id, n.id, n.parent, u.depth + 1 FROM up u JOIN node n ON u.parent = n.id)"""


def tree(spark, sf_dir) -> DataFrame:
    """(id, parent) of TREE."""
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = table(spark, sf_dir, "region").select(named("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    for name, own, above in (("nation", named("n", "n_nationkey"), named("r", "n_regionkey")), ("customer", named("c", "c_custkey"), named("n", "c_nationkey")), ("supplier", named("s", "s_suppkey"), named("n", "s_nationkey"))):
        out = out.union(table(spark, sf_dir, name).select(own, above))
    return out


def _within(nodes: DataFrame, **sets: tuple[str, ...]) -> DataFrame:
    """(id, and for each set whether a node or an ancestor is of it)."""
    chains = H.climbed(nodes, any_of={n: F.coalesce(F.col("id").isin(*ids), F.lit(False)) for n, ids in sets.items()})
    return chains.groupBy("id").agg(*[F.max(n).alias(n) for n in sets])


@BOOK.query("ancestor_chain", f"WITH {WALK} SELECT id, CAST(max(depth) AS BIGINT) AS depth, max(CASE WHEN parent IS NULL THEN anc END) AS root FROM up GROUP BY id")
def ancestor_chain(spark, sf_dir):
    """Every node's depth and its topmost ancestor, if no parent is missing."""
    return H.climbed(tree(spark, sf_dir)).groupBy("id").agg(F.max("depth").alias("depth"), F.max(F.when(F.col("whole"), F.col("root"))).alias("root"))


@BOOK.query("scope_authorized", f"""WITH {WALK},
  ok AS (SELECT id, max(CASE WHEN anc IN ('r0', 'r2') THEN 1 ELSE 0 END) AS in_root, max(CASE WHEN anc IN ('n3', 'n8', 'n12') THEN 1 ELSE 0 END) AS excluded FROM up GROUP BY id)
  SELECT id, CASE WHEN excluded = 1 THEN 'excluded' WHEN in_root = 1 THEN 'authorized' ELSE 'out_of_scope' END AS decision FROM ok""")
def scope_authorized(spark, sf_dir):
    """Every node's decision by two roots and three excluded nodes."""
    ok = _within(tree(spark, sf_dir), in_root=("r0", "r2"), excluded=("n3", "n8", "n12"))
    return ok.select("id", F.when(F.col("excluded"), "excluded").when(F.col("in_root"), "authorized").otherwise("out_of_scope").alias("decision"))


@BOOK.query("reachable_tree", f"""WITH RECURSIVE {TREE},
  down AS (SELECT id, parent, 0 AS depth FROM node WHERE id IN ('r1', 'r3')
    UNION ALL SELECT n.id, n.parent, d.depth + 1 FROM down d JOIN node n ON n.parent = d.id WHERE d.depth < 64)
  SELECT id, parent, CAST(min(depth) AS BIGINT) AS depth FROM down GROUP BY id, parent""")
def reachable_tree(spark, sf_dir):
    """All nodes below two roots, with their least depth."""
    nodes = tree(spark, sf_dir)
    return H.descended(nodes, nodes.filter(F.col("id").isin("r1", "r3")), 64)


@BOOK.query("target_placement", f"""WITH {WALK},
  placed AS (SELECT id FROM up GROUP BY id HAVING max(CASE WHEN anc IN ('r0', 'r1') THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN anc = 'n5' THEN 1 ELSE 0 END) = 0)
  SELECT 'c' || o_custkey AS target, CAST(count(*) AS BIGINT) AS edges, max(CASE WHEN p.id IS NULL THEN 0 ELSE 1 END) = 1 AS resolved
  FROM orders LEFT JOIN placed p ON p.id = 'c' || o_custkey GROUP BY o_custkey""")
def target_placement(spark, sf_dir):
    """Orders by the customer that they point to, and whether that one lies below two regions and not in a nation that is left out."""
    placed = _within(tree(spark, sf_dir), in_root=("r0", "r1"), left_out=("n5",)).filter("in_root AND NOT left_out").select(F.col("id").alias("target"), F.lit(True).alias("placed"))
    edges = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("edges")).withColumn("target", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return edges.join(placed, "target", "left").select("target", "edges", F.coalesce("placed", F.lit(False)).alias("resolved"))


BOOK.sql("hit_placement", """SELECT o_orderkey, CASE WHEN n_regionkey IN (0, 1) AND c_mktsegment = 'BUILDING' THEN 'root' WHEN n_regionkey IN (0, 1) THEN 'child_of_root' WHEN n_nationkey IN (8, 9, 12) THEN 'known_parent' WHEN c_custkey IS NOT NULL THEN 'sibling_source' ELSE 'unplaced' END AS placement
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")

EDGES = """
edge AS (SELECT DISTINCT c_nationkey AS source, s_nationkey AS target, 'relation' AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49 AND l_discount >= 9e-2
  UNION ALL SELECT DISTINCT n_nationkey, n_regionkey + 20, 'parent' FROM nation WHERE n_regionkey + 20 <> n_nationkey)"""
BOOK.sql("related_depth1", f"""WITH {EDGES}
  SELECT DISTINCT source, target, kind, CASE WHEN source = 3 THEN 'outgoing' ELSE 'incoming' END AS direction FROM edge WHERE source = 3 OR target = 3 ORDER BY source, target, kind LIMIT 100""")
BOOK.sql("related_depth2", f"""WITH {EDGES},
  both_ways AS (SELECT source AS a, target AS b FROM edge UNION SELECT target, source FROM edge),
  one AS (SELECT DISTINCT b AS node FROM both_ways WHERE a = 3),
  reach AS (SELECT node, 1 AS hop FROM one UNION ALL SELECT w.b, 2 FROM one JOIN both_ways w ON w.a = one.node)
  SELECT node, CAST(min(hop) AS BIGINT) AS hop FROM reach WHERE node <> 3 GROUP BY node""")
BOOK.sql("relation_edges", """SELECT DISTINCT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, 'page' AS relation, p_partkey IS NOT NULL AS resolved
  FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) kept ON l_partkey = p_partkey""")
BOOK.sql("edge_family_replace", """WITH stored AS (SELECT l_orderkey AS page, l_partkey AS target, CASE WHEN l_linenumber <= 2 THEN 'relation' ELSE 'link' END AS family FROM lineitem),
  incoming AS (SELECT o_orderkey AS page, o_custkey AS target, 'relation' AS family FROM orders WHERE o_orderstatus = 'F')
  SELECT page, target, family FROM stored WHERE family <> 'relation' UNION SELECT page, target, family FROM stored WHERE family = 'relation' AND NOT EXISTS (SELECT 1 FROM incoming WHERE incoming.page = stored.page) UNION SELECT page, target, family FROM incoming""")
BOOK.sql("alias_lookup", r"""SELECT DISTINCT lower(trim(REPALL(p_name ; '[ ]+' ; ' '))) AS alias, p_partkey AS page FROM part WHERE p_name IS NOT NULL AND length(trim(p_name)) BETWEEN 1 AND 256""")
BOOK.sql("alias_all_roots", r"""SELECT alias, CAST(count(DISTINCT page) AS BIGINT) AS pages, min(page) AS first_page FROM (
  SELECT lower(trim(p_name)) AS alias, p_partkey AS page FROM part UNION SELECT lower(trim(c_name)), c_custkey FROM customer UNION SELECT lower(trim(s_name)), s_suppkey FROM supplier) a GROUP BY alias""")
BOOK.sql("page_kind_counts", """SELECT CASE WHEN s_suppkey IS NULL THEN 'standalone' ELSE 'database' END AS kind, CAST(count(*) AS BIGINT) AS pages FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey GROUP BY 1""")
BOOK.sql("listing_cache", """SELECT d.doc_id, p.url, d.n_chars FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id""")
BOOK.sql("projection_complete", """SELECT l_orderkey AS page, CAST(count(*) AS BIGINT) AS edges, SHA(AGGSTR(CAST(l_partkey AS VARCHAR(20)) || ':' || CAST(l_linenumber AS VARCHAR(20)))) AS identity FROM lineitem GROUP BY l_orderkey""")
BOOK.sql("scope_identity", """SELECT source AS root_id, SHA(AGGSTR(lang)) AS identity FROM (SELECT DISTINCT source, lang FROM documents WHERE lang IS NOT NULL) d GROUP BY source""")
BOOK.sql("metadata_identity", "SELECT doc_id, SHA('v1|' || CAST(doc_id AS VARCHAR(20)) || '|' || coalesce(lang, '') || '|' || coalesce(source, '')) AS identity FROM documents")


@BOOK.query("link_edges", r"""WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages)
  SELECT page_id, target, CAST(min(pos) AS BIGINT) AS first_pos, CASE WHEN starts_with(target, '#') THEN 'block' WHEN starts_with(target, 'http://') OR starts_with(target, 'https://') THEN 'external' WHEN starts_with(target, '/') THEN 'page' ELSE 'invalid' END AS kind FROM found GROUP BY page_id, target""")
def link_edges(spark, sf_dir):
    """Targets of a page's links, typed; of repeated ones the first place."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "target"))
    kind = F.when(F.startswith("target", F.lit("#")), "block").when(F.startswith("target", F.lit("http://")) | F.startswith("target", F.lit("https://")), "external").when(F.startswith("target", F.lit("/")), "page").otherwise("invalid")
    return found.groupBy("page_id", "target").agg((F.min("pos") + 1).cast("long").alias("first_pos")).withColumn("kind", kind)
