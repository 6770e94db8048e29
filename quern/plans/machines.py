"""Leases, inboxes, ledgers and schedules: folds over the events of a user in order, against recursive SQL that carries the state row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import policy as P
from quern.operators import states as S
from quern.plans.common import Book
from quern.views import table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: events as requests: op by event_type, in order of time and id within a user.
OPS = """e AS (SELECT user_id AS k, event_id, event_type, epoch_us(ts) // 1000 AS now_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


def _ops(spark, sf_dir, ops: dict[str, str], **more):
    chosen = F.element_at(F.create_map(*[F.lit(x) for pair in ops.items() for x in pair]), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"), chosen.alias("op"), *[c.alias(n) for n, c in more.items()])
    return rows


def _case(ops: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ops.items()) + " END"


LEASE = {"view": "acquire", "click": "renew", "purchase": "release", "signup": "acquire", "error": "acquire"}


@BOOK.query("fenced_lease", f"""WITH RECURSIVE {OPS},
  r AS (SELECT k, event_id, n, now_ms, {_case(LEASE)} AS op, event_id % 3 AS who, least(greatest((event_id % 5000 * 1000 + 7 + 999) // 1000, 1), 3600) * 1000 AS ttl FROM e),
  s AS (SELECT k, n, event_id, CASE WHEN op = 'acquire' THEN 'acquired' ELSE 'lost' END AS outcome, CASE WHEN op = 'acquire' THEN who END AS holder, CASE WHEN op = 'acquire' THEN now_ms + ttl ELSE 0 END AS until, CASE WHEN op = 'acquire' THEN 1 ELSE 0 END AS fence FROM r WHERE n = 1
    UNION ALL SELECT r.k, r.n, r.event_id,
      CASE WHEN op = 'acquire' THEN CASE WHEN holder IS NOT NULL AND until > now_ms THEN 'busy' ELSE 'acquired' END WHEN NOT (holder IS NOT NULL AND until > now_ms AND holder = who) THEN 'lost' WHEN op = 'renew' THEN 'renewed' ELSE 'released' END,
      CASE WHEN op = 'acquire' AND NOT (holder IS NOT NULL AND until > now_ms) THEN who WHEN op = 'release' AND holder IS NOT NULL AND until > now_ms AND holder = who THEN NULL ELSE holder END,
      CASE WHEN op = 'acquire' AND NOT (holder IS NOT NULL AND until > now_ms) OR op = 'renew' AND holder IS NOT NULL AND until > now_ms AND holder = who THEN now_ms + ttl ELSE until END,
      CASE WHEN op = 'acquire' AND NOT (holder IS NOT NULL AND until > now_ms) THEN fence + 1 ELSE fence END
    FROM s JOIN r ON r.k = s.k AND r.n = s.n + 1)
  SELECT k, event_id, outcome, CAST(fence AS BIGINT) AS fence FROM s""")
def fenced_lease(spark, sf_dir):
    """Three holders contend for each user's lease."""
    rows = _ops(spark, sf_dir, LEASE, holder=F.col("event_id") % 3, ttl_ms=F.col("event_id") % 5000 * 1000 + 7)
    return S.folded(rows, "k", ["now_ms", "event_id"], S.lease, "outcome string, fence long").select("k", "event_id", "outcome", "fence")


LEDGER = {"view": "begin", "click": "unknown", "purchase": "commit", "signup": "begin", "error": "begin"}


@BOOK.query("idempotency_claims", f"""WITH RECURSIVE {OPS}, r AS (SELECT k * 8 + event_id % 8 AS key, event_id, now_ms, {_case(LEDGER)} AS op, CASE WHEN event_id % 10 = 3 THEN 'b' ELSE 'a' END AS digest FROM e),
  o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY now_ms, event_id) AS n FROM r),
  s AS (SELECT key, n, event_id, CASE WHEN op = 'begin' THEN 'execute_once' ELSE 'no_request' END AS decision, CASE WHEN op = 'begin' THEN 'pending' END AS status, CASE WHEN op = 'begin' THEN digest END AS held FROM o WHERE n = 1
    UNION ALL SELECT o.key, o.n, o.event_id,
      CASE WHEN held IS NULL THEN CASE WHEN op = 'begin' THEN 'execute_once' ELSE 'no_request' END WHEN held <> digest THEN 'key_conflict' WHEN op = 'begin' THEN CASE WHEN status = 'committed' THEN 'replay' ELSE 'reconcile' END
        WHEN status = 'committed' THEN 'kept' WHEN op = 'commit' THEN 'committed' ELSE 'unknown' END,
      CASE WHEN held IS NULL THEN CASE WHEN op = 'begin' THEN 'pending' END WHEN held <> digest OR op = 'begin' OR status = 'committed' THEN status WHEN op = 'commit' THEN 'committed' ELSE 'unknown' END,
      CASE WHEN held IS NULL AND op = 'begin' THEN digest ELSE held END
    FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1)
  SELECT key, event_id, decision FROM s""")
def idempotency_claims(spark, sf_dir):
    rows = _ops(spark, sf_dir, LEDGER, digest=F.when(F.col("event_id") % 10 == 3, "b").otherwise("a")).withColumn("key", F.col("k") * 8 + F.col("event_id") % 8)
    return S.folded(rows, "key", ["now_ms", "event_id"], S.ledger, "decision string").select("key", "event_id", "decision")


INBOX = {"view": "claim", "click": "complete", "purchase": "retry", "signup": "requeue", "error": "permanent"}


@BOOK.query("inbox_machine", f"""WITH RECURSIVE {OPS}, o AS (SELECT k, n, event_id, now_ms, CASE WHEN n = 1 THEN 'deliver' ELSE {_case(INBOX)} END AS op, event_id % 4 AS g FROM e),
  s AS (SELECT k, n, event_id, 'pending' AS status, now_ms AS due, CAST(0 AS BIGINT) AS until, 0 AS gen, 0 AS attempt FROM o WHERE n = 1
    UNION ALL SELECT k, n, event_id,
      CASE WHEN dead THEN 'failed' WHEN taken THEN 'running' WHEN again THEN 'pending' WHEN fits AND op = 'complete' THEN 'done' WHEN fits AND (op = 'permanent' OR attempt >= 3) THEN 'failed' WHEN fits THEN 'pending' ELSE status END,
      CASE WHEN again THEN now_ms WHEN fits AND op = 'retry' AND attempt < 3 THEN now_ms + least(3600000 * CAST(power(2, attempt - 1) AS BIGINT), 14400000) ELSE due END,
      CASE WHEN taken THEN now_ms + 86400000 ELSE until END, CASE WHEN taken OR again THEN gen + 1 ELSE gen END, CASE WHEN taken THEN attempt + 1 WHEN again THEN 0 ELSE attempt END
    FROM (SELECT o.k, o.n, o.event_id, o.now_ms, o.op, s.status, s.due, s.until, s.gen, s.attempt,
        o.op = 'claim' AND s.status = 'running' AND s.until <= o.now_ms AND s.attempt >= 3 AS dead,
        o.op = 'claim' AND (s.status = 'running' AND s.until <= o.now_ms AND s.attempt < 3 OR s.status = 'pending' AND s.due <= o.now_ms) AS taken,
        o.op = 'requeue' AND s.status = 'failed' AND o.g = s.gen AS again,
        o.op IN ('complete', 'retry', 'permanent') AND s.status = 'running' AND o.g = s.gen AND s.until > o.now_ms AS fits
      FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1) t)
  SELECT k, event_id, status, CAST(gen AS BIGINT) AS generation_now, CAST(attempt AS BIGINT) AS attempt FROM s""")
def inbox_machine(spark, sf_dir):
    """A user's first event delivers; leases of a day, three attempts, waits from an hour to four."""
    rows = _ops(spark, sf_dir, INBOX, generation=F.col("event_id") % 4)
    first = rows.groupBy("k").agg(F.min(F.struct("now_ms", "event_id")).alias("first"))
    rows = rows.join(first, "k").withColumn("op", F.when(F.struct("now_ms", "event_id") == F.col("first"), "deliver").otherwise(F.col("op"))).drop("first")
    step = S.inbox(attempts=3, lease_ms=86_400_000, base_ms=3_600_000, most_ms=14_400_000)
    return S.folded(rows, "k", ["now_ms", "event_id"], step, "status string, generation_now long, attempt long").select("k", "event_id", "status", "generation_now", "attempt")


SCHEDULE = {"view": "claim", "click": "complete", "purchase": "fail", "signup": "hold", "error": "release"}


@BOOK.query("schedule_machine", f"""WITH RECURSIVE {OPS}, o AS (SELECT k, n, event_id, now_ms, CASE WHEN n = 1 THEN 'register' WHEN event_id % 37 = 0 THEN 'abandon' WHEN event_id % 41 = 0 THEN 'reconfigure' ELSE {_case(SCHEDULE)} END AS op FROM e),
  s AS (SELECT k, n, event_id, 'waiting' AS phase, now_ms + 3600000 AS due, 0 AS failures, FALSE AS held FROM o WHERE n = 1
    UNION ALL SELECT o.k, o.n, o.event_id,
      CASE WHEN op = 'claim' AND phase = 'waiting' AND NOT held AND due <= now_ms THEN 'running' WHEN op IN ('complete', 'abandon') AND phase = 'running' THEN 'waiting'
        WHEN op = 'fail' AND phase = 'running' THEN CASE WHEN failures + 1 >= 3 THEN 'exhausted' ELSE 'waiting' END WHEN op = 'reconfigure' AND phase IN ('waiting', 'exhausted') THEN 'waiting' ELSE phase END,
      CASE WHEN op IN ('complete', 'abandon') AND phase = 'running' OR op = 'reconfigure' AND phase IN ('waiting', 'exhausted') THEN now_ms + 3600000
        WHEN op = 'fail' AND phase = 'running' AND failures + 1 < 3 THEN now_ms + least(60000 * CAST(power(2, failures) AS BIGINT), 3600000) ELSE due END,
      CASE WHEN op = 'complete' AND phase = 'running' OR op = 'reconfigure' AND phase IN ('waiting', 'exhausted') THEN 0 WHEN op = 'fail' AND phase = 'running' THEN failures + 1 ELSE failures END,
      CASE WHEN op = 'hold' THEN TRUE WHEN op = 'release' THEN FALSE ELSE held END
    FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1)
  SELECT k, event_id, CASE WHEN held AND phase = 'waiting' THEN 'held' ELSE phase END AS phase, due AS due_ms, CAST(failures AS BIGINT) AS failures FROM s""")
def schedule_machine(spark, sf_dir):
    """A user's first event registers an hourly schedule; others claim, complete, fail, hold, release, abandon or reconfigure it."""
    rows = _ops(spark, sf_dir, SCHEDULE)
    first = rows.groupBy("k").agg(F.min(F.struct("now_ms", "event_id")).alias("first"))
    op = F.when(F.struct("now_ms", "event_id") == F.col("first"), "register").when(F.col("event_id") % 37 == 0, "abandon").when(F.col("event_id") % 41 == 0, "reconfigure").otherwise(F.col("op"))
    rows = rows.join(first, "k").withColumn("op", op).drop("first")
    return S.folded(rows, "k", ["now_ms", "event_id"], S.schedule(3_600_000), "phase string, due_ms long, failures long").select("k", "event_id", "phase", "due_ms", "failures")


@BOOK.query("inbox_unassigned", "SELECT event_id FROM events WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 0)")
def inbox_unassigned(spark, sf_dir):
    """Deliveries that no page's members hold."""
    held = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").filter("event_type = 'error'").join(held.hint("merge"), "user_id", "left_anti").select("event_id")


@BOOK.query("event_admission", """SELECT event_id, lower(event_type) AS kind, CASE WHEN user_id IS NULL THEN 'no_page' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'ignored_kind' WHEN ts IS NULL THEN 'no_time' ELSE 'admitted' END AS admission FROM events""")
def event_admission(spark, sf_dir):
    kind = F.lower("event_type")
    admission = F.when(F.col("user_id").isNull(), "no_page").when(~kind.isin("click", "view", "purchase"), "ignored_kind").when(F.col("ts").isNull(), "no_time").otherwise("admitted")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), admission.alias("admission"))


@BOOK.query("hold_of_cycle", """SELECT user_id, event_type = 'error' AS held FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type IN ('error', 'signup')) WHERE rn = 1""")
def hold_of_cycle(spark, sf_dir):
    """The latest hold or release decides."""
    rows = table(spark, sf_dir, "events").filter("event_type IN ('error', 'signup')")
    return rows.groupBy("user_id").agg((F.max_by("event_type", "event_id") == "error").alias("held"))


_NAMES = "CASE event_type WHEN 'view' THEN 'knowledge_search' WHEN 'click' THEN 'knowledge_get' WHEN 'purchase' THEN 'knowledge_append' WHEN 'signup' THEN 'knowledge_archive_page' ELSE event_type END"


@BOOK.query("capability_matrix", f"""WITH r AS (SELECT event_id, {_NAMES} AS operation FROM events)
  SELECT event_id, operation, CASE WHEN operation = 'error' THEN 'unknown' WHEN operation IN ('knowledge_archive_page') THEN 'blocked' ELSE 'allowed' END AS listed,
    CASE WHEN operation = 'error' THEN 'unknown' WHEN operation IN ('knowledge_append', 'knowledge_archive_page') THEN 'read_only' ELSE 'allowed' END AS reading,
    CASE WHEN operation = 'error' THEN 'unknown' ELSE 'not_listed' END AS nothing FROM r""")
def capability_matrix(spark, sf_dir):
    """A block list beats categories; read-only; an empty allow list."""
    op = F.when(F.col("event_type") == "view", "knowledge_search").when(F.col("event_type") == "click", "knowledge_get").when(F.col("event_type") == "purchase", "knowledge_append").when(F.col("event_type") == "signup", "knowledge_archive_page").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", op.alias("operation"))
    own = F.col("operation")
    return rows.withColumns({"listed": P.allowed(own, ["read", "write"], ["knowledge_archive_page"]), "reading": P.allowed(own, read_only=True), "nothing": P.allowed(own, [])})


@BOOK.query("confirmation_permits", """WITH r AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'error' THEN 'update' ELSE 'append' END AS operation, user_id AS digest, ts FROM events),
  d AS (SELECT *, operation IN ('delete', 'update') AS heavy, row_number() OVER (PARTITION BY digest, operation IN ('delete', 'update') ORDER BY ts, id) AS n FROM r)
  SELECT id, operation, digest, CASE WHEN NOT heavy THEN 'allowed' WHEN digest % 2 = 1 THEN 'no_permit' WHEN n = 1 THEN 'allowed' ELSE 'consumed' END AS decision FROM d""")
def confirmation_permits(spark, sf_dir):
    """Destructive requests of even users have one permit each, which the first consumes."""
    op = F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "error", "update").otherwise("append")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), op.alias("operation"), F.col("user_id").alias("digest"), F.col("ts").alias("at"))
    permits = rows.select("digest").distinct().filter("digest % 2 = 0")
    return P.confirmation(rows, permits, True).drop("at")


@BOOK.query("search_fence", """WITH l AS (SELECT user_id % 50 AS generation, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
  SELECT generation, bool_and(event_type NOT IN ('error', 'view')) AS open FROM l WHERE rn = 1 GROUP BY generation""")
def search_fence(spark, sf_dir):
    """A generation is open once no operation's last receipt is pending (view) or failed (error)."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "pending").otherwise("applied")
    return P.search_open(table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("generation"), F.col("user_id").alias("operation"), F.col("event_id").alias("at"), status.alias("status")))


@BOOK.query("authority_change", """SELECT c_nationkey AS scope, CASE WHEN c_nationkey % 6 = 0 THEN 'not_advanced' WHEN max(CASE WHEN c_acctbal < 0 AND c_custkey % 5 = 0 THEN 1 ELSE 0 END) = 1 THEN 'other_set' ELSE 'accepted' END AS verdict FROM customer GROUP BY c_nationkey""")
def authority_change(spark, sf_dir):
    """Unresolved are customers in debt; the change names all but every fifth."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope"), F.col("c_custkey").alias("operation"), "c_acctbal")
    open_ones = rows.filter("c_acctbal < 0").select("scope", "operation")
    epochs = rows.select("scope").distinct().select("scope", F.lit(3).alias("epoch"), F.lit(7).alias("generation"), F.when(F.col("scope") % 6 == 0, 3).otherwise(4).alias("next_epoch"), F.lit(8).alias("next_generation"))
    return P.authority(epochs, open_ones, open_ones.filter("operation % 5 <> 0"))


@BOOK.query("health_combined", """WITH l AS (SELECT user_id, event_id % 2 AS dependency, arg_max(event_type <> 'error', epoch_us(ts) // 1000 * 1000000 + event_id) AS ok, max(epoch_us(ts) // 1000) AS at_ms FROM events GROUP BY 1, 2)
  SELECT user_id AS subject, CASE WHEN max(at_ms) IS NOT NULL AND bool_or(1706572800000 - at_ms > 172800000) THEN 'unknown' WHEN bool_and(ok) THEN 'healthy' ELSE 'unhealthy' END AS health FROM l GROUP BY 1""")
def health_combined(spark, sf_dir):
    """Two dependencies a user; an observation over two days old is stale."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), (F.col("event_id") % 2).alias("dependency"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return P.healthy(rows.select("subject", "dependency", (F.col("at")).alias("at_ms"), "ok").join(rows.groupBy("subject", "dependency").agg(F.max(F.struct("at", "event_id")).alias("last")).select("subject", "dependency", F.col("last.at").alias("at_ms")), ["subject", "dependency", "at_ms"], "left_semi"), F.lit(1706572800000), 172_800_000)


@BOOK.query("written_match", r"""SELECT doc_id, length(text) % 3 <> 2 AS matches, CAST(ceil(length(text) / 1000e0) AS BIGINT) AS lease_s, CASE WHEN lang IS NULL AND source IS NULL THEN NULL ELSE coalesce(lang = 'en', FALSE) OR coalesce(source = 'src1', FALSE) END AS inactive FROM documents WHERE text IS NOT NULL""")
def written_match(spark, sf_dir):
    """A readback that is equal, has one line feed more, or two more; waits in whole seconds; an inactive flag over optional ones."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    back = F.concat("text", F.repeat(F.lit("\n"), F.length("text") % 3))
    return docs.select("doc_id", P.written_matches(F.col("text"), back).alias("matches"), P.lease_seconds(F.length("text")).alias("lease_s"), P.inactive(F.col("lang") == "en", F.col("source") == "src1").alias("inactive"))


BATCHES = {"view": "hint", "click": "hint", "purchase": "claim", "signup": "complete", "error": "retry"}
_HOUR = 3_600_000
#: o0, o1: open members never and once claimed; r0, r1: frozen ones by what they were before; n...: the newest of each.
_BATCH = f"""WITH RECURSIVE {OPS}, o AS (SELECT k, n, event_id, now_ms, {_case(BATCHES)} AS op, 1 + event_id % 3 AS g FROM e),
  s AS (SELECT k, CAST(0 AS BIGINT) AS n, 0 AS o0, 0 AS o1, 0 AS r0, 0 AS r1, CAST(NULL AS BIGINT) AS no0, CAST(NULL AS BIGINT) AS no1, CAST(NULL AS BIGINT) AS nr0, CAST(NULL AS BIGINT) AS nr1,
      CAST(NULL AS BIGINT) AS first, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS until, 0 AS gen, 0 AS failed, '' AS outcome, 0 AS size, CAST(NULL AS BIGINT) AS newest, CAST(NULL AS BIGINT) AS event_id FROM e WHERE n = 1
    UNION ALL SELECT k, n, CASE WHEN taken THEN 0 ELSE o0 END, CASE WHEN taken THEN 0 ELSE o1 END, CASE WHEN taken THEN o0 ELSE r0 END, CASE WHEN taken THEN o1 ELSE r1 END,
      CASE WHEN NOT taken THEN no0 END, CASE WHEN NOT taken THEN no1 END, CASE WHEN taken THEN no0 ELSE nr0 END, CASE WHEN taken THEN no1 ELSE nr1 END,
      CASE WHEN NOT taken THEN first END, CASE WHEN NOT taken THEN due END, CASE WHEN taken THEN now_ms + {48 * _HOUR} ELSE until END, CASE WHEN taken THEN gen + 1 ELSE gen END, failed,
      CASE op WHEN 'hint' THEN CASE WHEN had THEN 'joined' ELSE 'opened' END WHEN 'claim' THEN CASE WHEN taken THEN 'claimed' WHEN until IS NOT NULL THEN 'busy' WHEN o0 + o1 = 0 THEN 'none' ELSE 'early' END
        ELSE CASE WHEN NOT live THEN 'lost' WHEN op = 'complete' THEN 'completed' ELSE 'returned' END END,
      CASE WHEN op = 'complete' AND live THEN held ELSE o0 + o1 END, CASE WHEN taken THEN greatest(no0, no1) END, event_id
    FROM (SELECT *, op = 'claim' AND until IS NULL AND o0 + o1 > 0 AND due <= now_ms AS taken FROM (
      SELECT k, n, event_id, now_ms, op, live, had, held, gen, o0 + CASE WHEN op = 'hint' THEN 1 ELSE 0 END AS o0, o1 + CASE WHEN back THEN r0 ELSE 0 END AS o1, CASE WHEN back OR op = 'complete' AND live THEN 0 ELSE r0 END AS r0, CASE WHEN back OR op = 'complete' AND live THEN 0 ELSE r1 END AS r1,
        CASE WHEN op = 'hint' THEN n ELSE no0 END AS no0, CASE WHEN back THEN greatest(no1, nr0) ELSE no1 END AS no1, CASE WHEN NOT (back OR op = 'complete' AND live) THEN nr0 END AS nr0, CASE WHEN NOT (back OR op = 'complete' AND live) THEN nr1 END AS nr1,
        CASE WHEN op = 'hint' OR back AND o0 + o1 + r0 > 0 THEN coalesce(first, now_ms) ELSE first END AS first,
        CASE WHEN op = 'hint' THEN least(now_ms + {6 * _HOUR}, coalesce(first, now_ms) + {24 * _HOUR}) WHEN back AND o0 + o1 + r0 > 0 THEN coalesce(due, now_ms) ELSE due END AS due,
        CASE WHEN NOT (back OR op = 'complete' AND live) THEN until END AS until, failed + CASE WHEN back THEN r1 ELSE 0 END AS failed
      FROM (SELECT *, op = 'claim' AND coalesce(until <= now_ms, FALSE) OR op = 'retry' AND live AS back FROM (
        SELECT s.* EXCLUDE (n, event_id, outcome, size, newest), o.n, o.event_id, o.now_ms, o.op, coalesce(until > o.now_ms AND o.g = gen, FALSE) AS live, o0 + o1 > 0 AS had, r0 + r1 AS held FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1) a) b) c) d)
  SELECT s.k, s.event_id, outcome, CAST(gen AS BIGINT) AS generation_now, CAST(size AS BIGINT) AS size, e.event_id AS newest, CAST(failed AS BIGINT) AS failed FROM s LEFT JOIN e ON e.k = s.k AND e.n = s.newest WHERE s.n > 0"""


@BOOK.query("page_batch_machine", _BATCH)
def page_batch_machine(spark, sf_dir):
    """A user's views and clicks are hints; others claim, complete or retry: quiet for six hours, a day at most, leases of two days, two claims."""
    rows = _ops(spark, sf_dir, BATCHES, generation=1 + F.col("event_id") % 3)
    step = S.page_batches(6 * _HOUR, 24 * _HOUR, 48 * _HOUR, attempts=2)
    return S.folded(rows, "k", ["now_ms", "event_id"], step, "outcome string, generation_now long, size long, newest long, failed long").select("k", "event_id", "outcome", "generation_now", "size", "newest", "failed")


@BOOK.query("admission_feedback", f"""WITH RECURSIVE {OPS}, o AS (SELECT k, n, event_id, now_ms, 1 + event_id % 3 AS weight, {12 * _HOUR} * (1 + event_id % 4) AS hold FROM e),
  s AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, CAST([] AS STRUCT(until BIGINT, weight BIGINT)[]) AS running, CAST(0 AS BIGINT) AS peak, CAST(0 AS BIGINT) AS rejected, FALSE AS admitted, CAST(0 AS BIGINT) AS active FROM o WHERE n = 1
    UNION ALL SELECT k, n, event_id, CASE WHEN fits THEN list_append(left_over, struct_pack(until := now_ms + hold, weight := CAST(weight AS BIGINT))) ELSE left_over END, greatest(peak, used + CASE WHEN fits THEN weight ELSE 0 END), rejected + CASE WHEN fits THEN 0 ELSE 1 END, fits, used + CASE WHEN fits THEN weight ELSE 0 END
    FROM (SELECT *, used + weight <= 4 AS fits FROM (SELECT *, CAST(coalesce(list_sum(list_transform(left_over, lambda x: x.weight)), 0) AS BIGINT) AS used FROM (
      SELECT o.*, s.peak, s.rejected, list_filter(s.running, lambda x: x.until > o.now_ms) AS left_over FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1) a) b) c)
  SELECT k, event_id, admitted, CAST(active AS BIGINT) AS active, CAST(peak AS BIGINT) AS peak, rejected FROM s WHERE n > 0""")
def admission_feedback(spark, sf_dir):
    """A user's requests weigh one to three and run for half a day to two days; four may run together."""
    rows = _ops(spark, sf_dir, BATCHES, weight=1 + F.col("event_id") % 3, hold_ms=12 * _HOUR * (1 + F.col("event_id") % 4))
    return S.folded(rows, "k", ["now_ms", "event_id"], S.admission(4), "admitted boolean, active long, peak long, rejected long").select("k", "event_id", "admitted", "active", "peak", "rejected")
