"""Event-stream queries: inbox, debounce, retries, leases, schedules, metrics, over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.debounce import debounce
from quern.plans.common import Book
from quern.views import table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: Every tenth event is delivered twice.
INBOX = """
inbox AS (SELECT event_id, user_id AS page, event_type, ts, 1 AS attempt FROM events
  UNION ALL SELECT event_id, user_id, CASE WHEN event_id % 50 = 0 THEN 'changed' ELSE event_type END, ts, 2 FROM events WHERE event_id % 10 = 0)"""

BOOK.sql("inbox_dedup", f"""WITH {INBOX} SELECT event_id, CAST(count(*) AS BIGINT) AS deliveries, CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate' ELSE 'new' END AS outcome FROM inbox GROUP BY event_id""")
BOOK.sql("inbox_claim_order", """SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS turn FROM events WHERE event_type <> 'view'""")
BOOK.sql("retry_backoff", """SELECT event_id, event_id % 8 + 1 AS attempt, CASE WHEN event_id % 8 + 1 >= 6 THEN NULL ELSE MILLIS(ts) + CAST(least(1000e0 * power(2e0, event_id % 8), 60000e0) AS BIGINT) END AS retry_at_ms FROM events""")
BOOK.sql("debounce_gap_batches", """WITH stepped AS (SELECT user_id, event_id, ts, MILLIS(ts) AS ms, MILLIS(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS before FROM events WHERE event_type IN ('click', 'view')),
  marked AS (SELECT *, sum(CASE WHEN before IS NULL OR ms - before > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS batch FROM stepped)
  SELECT user_id, CAST(batch AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS events, CAST(max(ms) + 3600000 AS BIGINT) AS due_ms, max(event_id) AS largest_id FROM marked GROUP BY user_id, batch""")
BOOK.sql("schedule_history", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn <= 3""")
BOOK.sql("latest_state", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1")
BOOK.sql("commit_receipts", """SELECT user_id AS operation, CAST(count(*) AS BIGINT) AS attempts, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS applied, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 THEN 'applied' WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 'failed' ELSE 'pending' END AS status FROM events GROUP BY user_id""")
BOOK.sql("idempotency_ledger", f"""WITH {INBOX} SELECT event_id, attempt, CASE WHEN first_type = event_type THEN CASE WHEN attempt = 1 THEN 'execute' ELSE 'replay' END ELSE 'mismatch' END AS decision FROM (
  SELECT *, first_value(event_type) OVER (PARTITION BY event_id ORDER BY attempt) AS first_type FROM inbox) i""")
BOOK.sql("audit_retention", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00'")
BOOK.sql("operational_metrics", """SELECT kind, CAST(count(*) AS BIGINT) AS waiting, MILLIS(min(ts)) AS oldest_ms, greatest(CAST(0 AS BIGINT), MILLIS(max(ts)) - MILLIS(min(ts))) AS age_ms FROM (
  SELECT 'inbox' AS kind, ts FROM events WHERE event_type = 'click' UNION ALL SELECT 'refresh', ts FROM events WHERE event_type = 'error') u GROUP BY kind""")
BOOK.sql("latency_histogram", """WITH edges AS (SELECT 1e0 AS le UNION ALL SELECT 5e0 UNION ALL SELECT 10e0 UNION ALL SELECT 25e0 UNION ALL SELECT 50e0 UNION ALL SELECT 100e0 UNION ALL SELECT 250e0 UNION ALL SELECT 500e0 UNION ALL SELECT 1000e0)
  SELECT event_type, le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS BIGINT) AS cumulative, CAST(count(value) AS BIGINT) AS total FROM (SELECT event_type, value FROM events) e CROSS JOIN edges GROUP BY event_type, le""")
BOOK.sql("gauge_peak", """SELECT user_id, CAST(max(active) AS BIGINT) AS peak FROM (SELECT user_id, sum(CASE WHEN event_type IN ('click', 'signup') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS active FROM events) e GROUP BY user_id""")
BOOK.sql("admission_budget", """SELECT event_id, running, running <= 64 AS admitted FROM (SELECT event_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 ELSE 8 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM events) e""")
BOOK.sql("request_pacing", "SELECT event_id, greatest(CAST(0 AS BIGINT), 334 - (MILLIS(ts) - MILLIS(before))) AS wait_ms FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) e WHERE before IS NOT NULL")
BOOK.sql("page_timing_parts", "SELECT event_id, round(value * 2e-1, 6) AS fetch_ms, round(value * 3e-1, 6) AS parse_ms, round(value - round(value * 2e-1, 6) - round(value * 3e-1, 6), 6) AS rest_ms FROM events WHERE value IS NOT NULL")
BOOK.sql("authority_fence", "SELECT user_id, CAST(count(*) AS BIGINT) AS fence, max(event_id) AS holder, count(*) FILTER (WHERE event_type = 'error') > 0 AS lost FROM events GROUP BY user_id")
BOOK.sql("exists_page_work", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')")
BOOK.sql("unreleased_intents", "SELECT event_id, event_id % 3 + 1 AS attempts FROM events WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderstatus = 'P')")
BOOK.sql("requeue_cas", "SELECT event_id, event_id % 4 AS generation, CASE WHEN event_id % 4 = user_id % 4 THEN 'requeued' ELSE 'stale' END AS outcome FROM events WHERE event_type = 'error'")
BOOK.sql("optimize_cadence", "SELECT event_id, CAST(turn AS BIGINT) AS turn FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) e WHERE turn % 32 = 0")
BOOK.sql("health_staleness", "SELECT user_id, MILLIS(max(ts)) AS seen_ms, MILLIS(TIMESTAMP '2024-01-30 00:00:00') - MILLIS(max(ts)) > 90000 AS stale FROM events GROUP BY user_id")
BOOK.sql("outcome_counters", "SELECT event_type, CASE WHEN value IS NULL THEN 'none' WHEN value < 10 THEN 'low' ELSE 'high' END AS result, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")


@BOOK.query("debounce_batches")
def debounce_batches(spark, sf_dir):
    """Trailing-edge batches with a cap, folded per page; no SQL form (order-dependent state), tested against a plain fold."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return debounce(events.select(F.col("user_id").alias("page"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")), quiet_ms=3_600_000, cap_ms=4 * 3_600_000)
