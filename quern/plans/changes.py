"""Snapshot, inventory and commit queries: two states of orders, diffs, merges, holds and receipts."""

from __future__ import annotations

from quern.plans.common import Book

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: The next state drops every 11th order, edits every 7th, moves every 13th, trashes every 17th and adds a few.
SNAPSHOTS = """
prev AS (SELECT o_orderkey AS page, o_custkey AS parent, CAST(o_totalprice AS VARCHAR(40)) AS body, o_orderpriority AS title FROM orders WHERE o_orderkey % 19 <> 0),
next AS (SELECT o_orderkey AS page, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS parent,
  CASE WHEN o_orderkey % 7 = 0 THEN 'edited ' || CAST(o_orderkey AS VARCHAR(40)) ELSE CAST(o_totalprice AS VARCHAR(40)) END AS body, o_orderpriority AS title, o_orderkey % 17 = 0 AS trashed
  FROM orders WHERE o_orderkey % 11 <> 0)"""
SAME = SNAPSHOTS.replace("CAST(o_totalprice AS VARCHAR(40))", "o_orderstatus")
DIFF = f"""{SAME},
diff AS (SELECT coalesce(p.page, n.page) AS page, CASE WHEN n.page IS NULL THEN 'removed' WHEN n.trashed THEN 'trashed' WHEN p.page IS NULL THEN 'added' WHEN p.body <> n.body THEN 'changed' WHEN p.parent <> n.parent THEN 'moved' ELSE 'same' END AS class
  FROM prev p FULL JOIN next n ON p.page = n.page)"""

BOOK.sql("inventory_diff", f"WITH {DIFF} SELECT page, class FROM diff WHERE class <> 'same'")
BOOK.sql("dry_run_diff", f"WITH {DIFF} SELECT class, CAST(count(*) AS BIGINT) AS pages, CAST(min(page) AS BIGINT) AS first_page FROM diff GROUP BY class")
BOOK.sql("drift_counts", f"""WITH {DIFF} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE class = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (WHERE class = 'changed') AS BIGINT) AS changed,
  CAST(count(*) FILTER (WHERE class = 'moved') AS BIGINT) AS moved, CAST(count(*) FILTER (WHERE class = 'removed') AS BIGINT) AS removed, CAST(count(*) FILTER (WHERE class = 'trashed') AS BIGINT) AS trashed FROM diff""")
BOOK.sql("page_diff", f"""WITH {SAME} SELECT coalesce(p.page, n.page) AS page, CASE WHEN p.page IS NULL THEN 'added' WHEN n.page IS NULL THEN 'removed' WHEN SHA(p.body) = SHA(n.body) THEN 'skipped' ELSE 'changed' END AS action
  FROM prev p FULL JOIN next n ON p.page = n.page""")
BOOK.sql("snapshot_merge", f"""WITH {SAME}, live AS (SELECT page, parent, body FROM next WHERE NOT trashed)
  SELECT page, parent, body FROM live UNION ALL SELECT page, parent, body FROM prev WHERE NOT EXISTS (SELECT 1 FROM next WHERE next.page = prev.page) AND page % 2 = 0""")
BOOK.sql("revision_check", f"""WITH {SAME} SELECT p.page, CASE WHEN n.page IS NULL THEN 'missing' WHEN n.trashed THEN 'archived' WHEN SHA(p.body) <> SHA(n.body) THEN 'conflict' ELSE 'accepted' END AS outcome FROM prev p LEFT JOIN next n ON p.page = n.page""")
BOOK.sql("source_freshness", f"""WITH {SAME} SELECT p.page, CASE WHEN n.page IS NULL THEN 'unknown' WHEN p.body <> n.body OR p.title <> n.title THEN 'stale' ELSE 'fresh' END AS freshness FROM prev p LEFT JOIN next n ON p.page = n.page""")
BOOK.sql("settled_hits", "SELECT o_orderkey AS page, MILLIS(o_orderdate) AS edited_ms, o_orderkey % 300 AS fetched_after_s, o_orderkey % 300 >= 120 AS settled FROM orders WHERE o_orderdate IS NOT NULL")
BOOK.sql("unreached_held", """WITH owned AS (SELECT c_custkey AS page, c_nationkey AS parent FROM customer),
  refused AS (SELECT n_nationkey AS parent FROM nation WHERE n_regionkey = 2), known AS (SELECT n_nationkey AS parent FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0),
  held AS (SELECT page FROM owned o WHERE EXISTS (SELECT 1 FROM refused r WHERE r.parent = o.parent) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.parent = o.parent)),
  readable AS (SELECT page FROM owned o WHERE NOT EXISTS (SELECT 1 FROM refused r WHERE r.parent = o.parent) AND page % 10 <> 0)
  SELECT o.page, CASE WHEN h.page IS NOT NULL THEN 'held' ELSE 'unreached' END AS state FROM owned o LEFT JOIN held h ON h.page = o.page WHERE NOT EXISTS (SELECT 1 FROM readable r WHERE r.page = o.page)""")
BOOK.sql("run_journal_counts", """SELECT o_orderstatus AS status, o_orderpriority AS action, CAST(count(*) AS BIGINT) AS work, CAST(sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS BIGINT) AS applied FROM orders GROUP BY o_orderstatus, o_orderpriority""")
BOOK.sql("success_runs", "SELECT c_mktsegment, max(o_orderkey) AS last_run, CAST(count(*) AS BIGINT) AS runs FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment")
BOOK.sql("high_water", "SELECT o_orderpriority, MILLIS(max(o_orderdate)) AS high_water_ms FROM orders GROUP BY o_orderpriority")
BOOK.sql("sync_status", """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS indexed, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS skipped,
  CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'P', 'O')) AS BIGINT) AS failed FROM orders""")
BOOK.sql("out_of_sync_pages", "SELECT o_orderkey AS page, o_orderstatus AS outcome FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 100")
BOOK.sql("progress_counters", "SELECT o_orderstatus AS outcome, CAST(count(*) AS BIGINT) AS pages, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent FROM orders GROUP BY o_orderstatus")
BOOK.sql("snapshot_checks", """SELECT CAST(count(*) AS BIGINT) AS chunks, CAST(count(*) - count(DISTINCT doc_id) AS BIGINT) AS repeated_ids, CAST(count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS BIGINT) AS blank, CAST(count(*) FILTER (WHERE doc_id IS NULL) AS BIGINT) AS no_id FROM documents""")
BOOK.sql("append_verify", r"""SELECT doc_id, SHA(text || chr(10) || 'appended') AS written, length(text || chr(10) || 'appended') - length(text) = 9 AS grown FROM documents WHERE text IS NOT NULL""")
BOOK.sql("write_request_valid", """SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' WHEN length(text) > 10000 THEN 'too_long' WHEN lang IS NULL THEN 'no_scope' ELSE 'valid' END AS verdict FROM documents""")
BOOK.sql("storage_stats", "SELECT source, CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT IDIV(doc_id ; 4)) AS BIGINT) AS pages, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
BOOK.sql("request_filters_valid", """SELECT p_partkey, CASE WHEN p_size IS NULL OR p_size < 1 THEN 'no_limit' WHEN p_size > 45 THEN 'limit_over' WHEN p_name IS NULL OR trim(p_name) = '' THEN 'blank_query' ELSE 'valid' END AS verdict FROM part""")
BOOK.sql("uuid_canonical", r"""SELECT c_custkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS id FROM (SELECT c_custkey, substring(SHA(CAST(c_custkey AS VARCHAR(20))), 1, 32) AS h FROM customer) c""")
BOOK.sql("file_kind_check", """SELECT page_id, CASE WHEN html IS NULL THEN 'empty' WHEN lower(substring(ltrim(html), 1, 9)) = '<!doctype' OR lower(substring(ltrim(html), 1, 5)) = '<html' THEN 'html' ELSE 'text' END AS kind, length(html) <= 1000000 AS fits FROM pages""")
