"""Snapshot queries through the sinks and identities of operators/snapshots.py: documents' lines as chunks, orders as pages, customers as a tree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import hierarchy as H
from quern.operators import snapshots as S
from quern.plans.common import Book
from quern.plans.navigation import TREE
from quern.views import table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: The digest of a chunk's page, section and hash.
MADE = """'chunk-id:' || sha256(encode('chunk-id') || from_hex(lpad(hex(octet_length(encode(CAST(page AS VARCHAR)))), 16, '0')) || encode(CAST(page AS VARCHAR)) || from_hex(lpad(hex(octet_length(encode(section))), 16, '0')) || encode(section) || from_hex(lpad(hex(64), 16, '0')) || encode(content_hash))"""
#: Stored chunks lack every fifth line and have another text in every seventh; their ids are digests, equal ones numbered. Drafts lack every sixth line.
LINES = f"""line AS (SELECT doc_id AS page, coalesce(source, '') AS section, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT page, section, pos, sha256(CASE WHEN pos % 7 = 2 THEN said || '!' ELSE said END) AS content_hash FROM line WHERE pos % 5 <> 3),
stored AS (SELECT *, base || CASE WHEN suffix > 0 THEN ':' || suffix ELSE '' END AS id FROM (SELECT *, {MADE} AS base, row_number() OVER (PARTITION BY page, section, content_hash ORDER BY pos) - 1 AS suffix FROM hashed)),
draft AS (SELECT page, section, pos, sha256(said) AS content_hash FROM line WHERE pos % 6 <> 4)"""


def _chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("page"), F.coalesce("source", F.lit("")).alias("section"), F.posexplode(F.split("text", "\n", -1)).alias("at", "said"))
    lines = lines.withColumn("pos", (F.col("at") + 1).cast("long"))
    stored = lines.filter("pos % 5 <> 3").select("page", "section", "pos", F.sha2(F.when(F.col("pos") % 7 == 2, F.concat("said", F.lit("!"))).otherwise(F.col("said")), 256).alias("content_hash"))
    twin = F.row_number().over(Window.partitionBy("page", "section", "content_hash").orderBy("pos")) - 1
    base = S.chunk_id(F.col("page").cast("string"), F.col("section"), F.col("content_hash"))
    stored = stored.withColumn("id", F.when(twin > 0, F.concat(base, F.lit(":"), twin.cast("string"))).otherwise(base))
    return stored, lines.filter("pos % 6 <> 4").select("page", "section", "pos", F.sha2("said", 256).alias("content_hash"))


@BOOK.query("chunks_identified", f"""WITH {LINES},
  d AS (SELECT *, row_number() OVER (PARTITION BY page, section, content_hash ORDER BY pos) AS nth FROM draft), s AS (SELECT *, row_number() OVER (PARTITION BY page, section, content_hash ORDER BY pos) AS nth FROM stored),
  hit AS (SELECT d.page, d.section, d.pos, d.content_hash, s.id FROM d LEFT JOIN s USING (page, section, content_hash, nth)),
  unused AS (SELECT page, section, count(*) AS n, max(id) AS left_id FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.page = s.page AND d.section = s.section AND d.content_hash = s.content_hash AND d.nth = s.nth) GROUP BY page, section),
  fresh AS (SELECT page, section, count(*) AS n FROM hit WHERE id IS NULL GROUP BY page, section),
  named AS (SELECT h.*, CASE WHEN h.id IS NULL AND f.n = 1 AND u.n = 1 THEN u.left_id END AS inherited, {MADE} AS made FROM hit h LEFT JOIN unused u USING (page, section) LEFT JOIN fresh f USING (page, section)),
  taken AS (SELECT page, base, suffix FROM stored),
  new AS (SELECT *, row_number() OVER (PARTITION BY page, made ORDER BY section, pos) AS k FROM named WHERE id IS NULL AND inherited IS NULL),
  copies AS (SELECT page, base, count(*) AS n FROM taken GROUP BY page, base),
  spare AS (SELECT page, made, x, row_number() OVER (PARTITION BY page, made ORDER BY x) AS k FROM (SELECT n.page, n.made, unnest(range(max(n.k) + coalesce(max(c.n), 0))) AS x FROM new n LEFT JOIN copies c ON c.page = n.page AND c.base = n.made GROUP BY n.page, n.made) s
    WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.page = s.page AND t.base = s.made AND t.suffix = s.x))
  SELECT page, section, pos, content_hash, coalesce(id, inherited) AS id, CASE WHEN id IS NOT NULL THEN 'kept' ELSE 'edited' END AS how FROM named WHERE id IS NOT NULL OR inherited IS NOT NULL
  UNION ALL SELECT n.page, n.section, n.pos, n.content_hash, n.made || CASE WHEN x > 0 THEN ':' || x ELSE '' END, 'new' FROM new n JOIN spare USING (page, made, k)""")
def chunks_identified(spark, sf_dir):
    stored, drafts = _chunks(spark, sf_dir)
    return S.identified(drafts, stored)


@BOOK.query("chunk_diff_metrics", f"""WITH {LINES}, a AS (SELECT page, pos, content_hash FROM stored), b AS (SELECT page, pos, content_hash FROM draft)
  SELECT (SELECT count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page = b.page AND a.pos = b.pos)) AS added, (SELECT count(*) FROM a JOIN b USING (page, pos) WHERE a.content_hash <> b.content_hash) AS changed,
    (SELECT count(*) FROM a JOIN b USING (page, pos, content_hash)) AS skipped, (SELECT count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.page = b.page AND a.pos = b.pos)) AS removed""")
def chunk_diff_metrics(spark, sf_dir):
    stored, drafts = (x.withColumn("key", F.concat_ws("/", "page", "pos")) for x in _chunks(spark, sf_dir))
    return S.metrics(S.difference(stored, drafts, "key", ["content_hash"]))


@BOOK.query("chunks_embedded", f"""WITH {LINES} SELECT d.page, d.pos, d.content_hash, CASE WHEN s.page IS NULL THEN 'fresh' ELSE 'reused' END AS vector FROM draft d LEFT JOIN stored s ON d.page = s.page AND d.pos = s.pos AND d.content_hash = s.content_hash""")
def chunks_embedded(spark, sf_dir):
    """Only what is new or changed is embedded anew."""
    stored, drafts = (x.withColumn("key", F.concat_ws("/", "page", "pos")) for x in _chunks(spark, sf_dir))
    made = S.embedded(drafts, stored.withColumn("vector", F.lit("reused")), "key", "content_hash", "vector", lambda rest: rest.withColumn("vector", F.lit("fresh")))
    return made.select("page", "pos", "content_hash", "vector")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("page_id"), "o_totalprice")


@BOOK.query("upsert_batch", """SELECT o_orderkey AS chunk_id, o_custkey AS page_id, CASE WHEN o_orderkey % 10 = 0 THEN 0e0 ELSE o_totalprice END AS o_totalprice FROM orders
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 1e0 FROM orders WHERE o_orderkey % 100 = 0""")
def upsert_batch(spark, sf_dir):
    stored = _orders(spark, sf_dir)
    fresh = stored.filter("chunk_id % 100 = 0").select((F.col("chunk_id") + 1_000_000_000).alias("chunk_id"), "page_id", F.lit(1.0).alias("o_totalprice"))
    return S.upserted(stored, stored.filter("chunk_id % 10 = 0").withColumn("o_totalprice", F.lit(0.0)).union(fresh), "chunk_id")


@BOOK.query("page_snapshot_merge", "SELECT o_orderkey AS chunk_id, o_custkey AS page_id, o_totalprice FROM orders WHERE o_custkey % 4 <> 0 OR o_orderkey % 2 = 0")
def page_snapshot_merge(spark, sf_dir):
    """Every fourth page comes with a snapshot of its even chunks; the odd ones of these pages go, those of others stay."""
    stored = _orders(spark, sf_dir)
    pages = stored.filter("page_id % 4 = 0").select("page_id").distinct()
    return S.pages_merged(stored, stored.filter("page_id % 4 = 0 AND chunk_id % 2 = 0"), pages, "page_id", "chunk_id")


@BOOK.query("page_delete", "SELECT o_orderkey AS chunk_id, o_custkey AS page_id, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def page_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("page_id"))
    return S.without_pages(_orders(spark, sf_dir), gone, "page_id")


@BOOK.query("inventory_classes", """WITH nxt AS (SELECT o_orderkey AS page, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS parent, CASE WHEN o_orderkey % 7 = 0 THEN 'edited' ELSE o_orderstatus END AS body, o_orderkey % 17 = 0 AS trashed FROM orders WHERE o_orderkey % 11 <> 0)
  SELECT o_orderkey AS page, CASE WHEN o_orderkey % 11 = 0 THEN 'removed' WHEN o_orderkey % 17 = 0 THEN 'trashed' WHEN o_orderkey % 19 = 0 THEN 'added' WHEN nxt.body <> o_orderstatus THEN 'changed' WHEN nxt.parent <> o_custkey THEN 'moved' ELSE 'same' END AS class
  FROM orders LEFT JOIN nxt ON page = o_orderkey WHERE NOT (o_orderkey % 19 = 0 AND o_orderkey % 11 = 0)""")
def inventory_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("parent"), F.col("o_orderstatus").alias("body"))
    walked = rows.filter("page % 11 <> 0").select("page", F.when(F.col("page") % 13 == 0, F.col("parent") + 1).otherwise(F.col("parent")).alias("parent"), F.when(F.col("page") % 7 == 0, "edited").otherwise(F.col("body")).alias("body"), (F.col("page") % 17 == 0).alias("trashed"))
    return S.inventory(rows.filter("page % 19 <> 0"), walked)


@BOOK.query("keyset_page", "SELECT event_id, user_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def keyset_page(spark, sf_dir):
    return S.pages_after(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 100, 50)


@BOOK.query("changed_since_rows", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def changed_since_rows(spark, sf_dir):
    return S.changed_since(table(spark, sf_dir, "orders"), "o_orderdate", F.to_timestamp(F.lit("1997-01-01")))[0].select("o_orderkey")


@BOOK.query("removal_hold", """WITH u AS (SELECT c_custkey AS page, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 2))
  SELECT page, CASE WHEN r = 'r2' OR n IN ('n1', 'n2') THEN 'held' ELSE 'removed' END AS state FROM u""")
def removal_hold(spark, sf_dir):
    """Region 2 has only now become inaccessible, as have nations 1 and 2; what lies below is held, the rest of the unreached goes."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).filter("n_regionkey IN (1, 2)")
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    lineage = rows.select(F.col("c_custkey").alias("page"), F.explode(F.array(named("n", "c_nationkey"), named("r", "n_regionkey"))).alias("ancestor"))
    before = lineage.select(F.col("ancestor").alias("page")).distinct().withColumn("outcome", F.when(F.col("page").isin("r2", "n1", "n2"), "readable").otherwise("inaccessible"))
    return S.removals_held(rows.select(F.col("c_custkey").alias("page")), before, lineage)


def _tree(spark, sf_dir):
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = lambda name: table(spark, sf_dir, name)
    parts = [t("region").select(named("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")), t("nation").select(named("n", "n_nationkey"), named("r", "n_regionkey"))]
    parts += [t("customer").select(named("c", "c_custkey"), named("n", "c_nationkey")), t("supplier").select(named("s", "s_suppkey"), named("n", "s_nationkey")), t("orders").select(named("o", "o_orderkey"), named("c", "o_custkey"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


DEEP = f"""{TREE[:-1]} UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, '' FROM orders)"""


@BOOK.query("chain_depth", f"""WITH RECURSIVE {DEEP}, up AS (SELECT id, id AS top, parent, 0 AS depth FROM node UNION ALL SELECT u.id, n.id, n.parent, u.depth + 1 FROM up u JOIN node n ON u.parent = n.id),
  best AS (SELECT id, max(depth) AS depth, arg_max(top, depth) AS root, arg_max(parent, depth) AS dangling FROM up GROUP BY id)
  SELECT id, CAST(depth AS BIGINT) AS depth, root, root[1] = 'r' AS whole FROM best""")
def chain_depth(spark, sf_dir):
    """Every node's depth and topmost ancestor by pointer doubling."""
    return H.climbed(_tree(spark, sf_dir))


@BOOK.query("chain_authorized", f"""WITH RECURSIVE {DEEP}, up AS (SELECT id, id AS top, parent FROM node UNION ALL SELECT u.id, n.id, n.parent FROM up u JOIN node n ON u.parent = n.id),
  f AS (SELECT id, bool_or(top IN ('n3', 'n8', 'n12')) AS left_out, bool_or(top LIKE 'r%') AS whole, bool_and(top NOT LIKE 'c%7') AS live, bool_or(top IN ('r0', 'r2')) AS in_root FROM up GROUP BY id)
  SELECT id, CASE WHEN left_out THEN 'excluded' WHEN NOT whole OR NOT live THEN 'broken' WHEN in_root THEN 'authorized' ELSE 'out_of_scope' END AS decision FROM f""")
def chain_authorized(spark, sf_dir):
    own = F.col("id")
    return H.authorized(_tree(spark, sf_dir), ~own.like("c%7"), own.isin("r0", "r2"), own.isin("n3", "n8", "n12"))


@BOOK.query("walk_tree", f"""WITH RECURSIVE {DEEP}, down AS (SELECT id, CAST(NULL AS VARCHAR) AS parent, 0 AS depth FROM node WHERE id IN ('r1', 'n2')
  UNION ALL SELECT n.id, n.parent, d.depth + 1 FROM down d JOIN node n ON n.parent = d.id WHERE n.id NOT IN ('r1', 'n2') AND d.id NOT LIKE 'c%9')
  SELECT id, parent, CAST(depth AS BIGINT) AS depth, FALSE AS complete FROM down""")
def walk_tree(spark, sf_dir):
    """From two roots down; claims of wrong parents are rejected, customers whose id ends in 9 can't be read."""
    nodes = _tree(spark, sf_dir)
    roots = nodes.filter(F.col("id").isin("r1", "n2")).select("id")
    claims = nodes.filter("parent IS NOT NULL").select("parent", F.col("id").alias("child"))
    wrong = claims.select(F.lit("n1").alias("parent"), "child").filter("child LIKE 'c%5'")
    seen, complete = H.walked(claims.union(wrong), roots, nodes, nodes.filter("id LIKE 'c%9'").select("id"))
    return seen.withColumn("complete", F.lit(complete))


@BOOK.query("database_rows", """SELECT o_orderpriority AS database, CAST(sum(n) AS BIGINT) AS rows, bool_and(n > 0 AND src % 5 <> 0 AND src % 7 <> 0) AS complete FROM (SELECT o_orderpriority, o_custkey % 40 AS src, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def database_rows(spark, sf_dir):
    """Data sources read by cursors: a fifth repeat a cursor, a seventh name one that is missing."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("database"), (F.col("o_custkey") % 40).alias("src")).agg(F.count("*").alias("n"))
    source = F.concat_ws("/", "database", "src")
    first = orders.select(source.alias("source"), F.lit(None).cast("string").alias("cursor"), F.lit("b").alias("next_cursor"), F.floor(F.col("n") / 2).alias("n"))
    second = orders.select(source.alias("source"), F.lit("b").alias("cursor"), F.when(F.col("src") % 5 == 0, "b").when(F.col("src") % 7 == 0, "z").alias("next_cursor"), (F.col("n") - F.floor(F.col("n") / 2)).alias("n"))
    again = second.filter("next_cursor = 'b'").withColumn("n", F.lit(0).cast("long"))
    return H.rows_of_databases(orders.select("database", source.alias("source")), first.union(second).union(again))


@BOOK.query("visit_outcomes", """SELECT doc_id, CASE WHEN source = 'src1' THEN 'excluded' WHEN lang IS NULL THEN 'unreadable' WHEN doc_id % 9 = 0 THEN 'wrong_parent' WHEN doc_id % 8 = 0 THEN 'trashed' WHEN text IS NULL OR text = '' THEN 'no_body' END AS skipped FROM documents""")
def visit_outcomes(spark, sf_dir):
    """The first of a page visit's checks that fails."""
    there = F.coalesce(F.col("text") != "", F.lit(False))
    skipped = H.visit_outcome(F.coalesce(F.col("source") == "src1", F.lit(False)), F.col("lang").isNotNull(), F.col("doc_id") % 9 != 0, F.col("doc_id") % 8 == 0, there)
    return table(spark, sf_dir, "documents").select("doc_id", skipped.alias("skipped"))
