"""Refusals, query forms, plans and machines by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from quern.functions import links as L
from quern.operators import expansion as X
from quern.operators import filters as Q
from quern.operators import hierarchy as H
from quern.operators import policy as P
from quern.operators import snapshots as S
from quern.operators import states


@pytest.mark.parametrize(
    "wanted",
    [
        {"page_id": ()},
        {"page_id": ("x" * 129,)},
        {"root_id": ("a\x07",)},
        {"page_id": tuple(str(k) for k in range(101))},
        {"kind": "other"},
        {"edited": (None, None)},
        {"edited": ("2024-01-02", "2024-01-02")},
        {"edited": ("2024-01-01T00:00:00", None)},
        {"edited": ("soon", None)},
        {"properties": tuple(Q.Contains(str(k), "x") for k in range(21))},
        {"properties": (Q.Dated("due"),)},
    ],
)
def test_bad_filters_are_refused_without_their_input(wanted):
    with pytest.raises(Q.Refused) as refused:
        Q.checked(Q.Filters(**wanted))
    assert "soon" not in str(refused.value) and "other" not in str(refused.value)


def test_requests_out_of_bounds(spark):
    for text, limit in ((" ", 1), ("x" * 4097, 1), ("x", 0), ("x", 101)):
        with pytest.raises(Q.Refused):
            Q.check_query(text, limit)
    rows = spark.range(30)
    assert Q.bounded(rows, 30).count() == 30
    with pytest.raises(Q.Refused):
        Q.bounded(rows, 29)
    assert Q.within_budget(rows).count() == 30
    with pytest.raises(Q.Refused):
        Q.within_budget(rows, 100)
    hit = "page_id long, chunk_id long, score double"
    assert Q.valid_hits(spark.createDataFrame([(1, 1, 0.5)], hit)).count() == 1
    for bad in ([(1, 1, float("nan"))], [(1, 1, float("inf"))], [(None, 1, 0.5)], [(1, 1, 0.5), (1, 1, 0.4)]):
        with pytest.raises(Q.Refused):
            Q.valid_hits(spark.createDataFrame(bad, hit))


def test_sinks_refuse(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    with pytest.raises(S.Conflict):
        S.upserted(stored, spark.createDataFrame([(3, "x"), (3, "y")], "id long, v string"), "id")
    with pytest.raises(S.Conflict):
        S.upserted(stored, spark.createDataFrame([(3, 1)], "id long, v long"), "id")
    assert not S.same_candidates(stored, stored.limit(1)) and S.same_candidates(stored, stored.orderBy(F.desc("id")))
    rows, whole = S.changed_since(stored, "id", F.lit(1), 1)
    assert not whole and [r.id for r in rows.collect()] == [2]
    assert S.synced(stored, stored, "id", False, lambda: stored.limit(0)).count() == 0


def test_query_forms():
    assert X.quoted_phrase(' "a b" ') == "a b" and X.quoted_phrase('"a" "b"') is None and X.quoted_phrase('""') is None and X.quoted_phrase('"a') is None
    assert X.is_identifier("0123456789abcdef0123456789ABCDEF") and X.is_identifier("chunk:" + "a" * 64 + ":2") and not X.is_identifier("chunk")
    assert X.literal("  Été  Bleu ") == "été bleu" and X.literal("a1") is None and X.literal("a b c d e") is None and X.literal("x" * 65) is None
    assert X.segmented("big red dog, red dog house", {"red dog", "dog house", "big", "dog, red"}) == ["big", "red dog", "red dog"]
    assert X.segmented("a b c d e", {"a b c d", "a", "e", "d e"}) == ["a b c d", "e"]
    assert X.segmented("abc123 don't abc_d x.abc 1,5 abc", {"abc", "don", "t", "d", "x"}) == ["abc"]
    assert X.segmented("abc 12 def", {"abc def", "abc", "def"}) == ["abc", "def"]
    assert len(X.segmented(" ".join(["a"] * 30), {"a"})) == X.MOST_UNITS
    assert len(X.positions(" ".join(["w"] * 300))) == X.MOST_WORDS


def test_plans_take_targets_in_turns(spark):
    edges = spark.createDataFrame([("one", f"u{k}") for k in range(5)] + [("two", "b"), ("two", "a"), ("three", "a"), ("three", "c"), ("four", "d")], "unit string, target string")
    made = X.plan("one two three four", edges)
    assert made.phrases == ("a", "d", "b", "c") and made.ambiguous == 1 and made.units == ("one", "two", "three", "four")
    assert X.plan('"two three"', edges).bypass == "quoted" and X.plan("0" * 32, edges).bypass == "identifier" and X.plan("?!", edges).phrases == ()


def test_broken_and_circular_chains(spark):
    rows = [("a", None), ("b", "a"), ("c", "gone"), ("x", "y"), ("y", "z"), ("z", "x"), ("t", "x")] + [(f"n{k}", f"n{k - 1}" if k else "a") for k in range(40)]
    got = {r.id: (r.depth, r.root, r.whole) for r in H.climbed(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert got["a"] == (0, "a", True) and got["n39"] == (40, "a", True) and got["c"] == (0, "c", False)
    assert all(got[k][1:] == (None, False) for k in "xyzt")


def test_walk_defers_wrong_parents(spark):
    claims = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    proof = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "b")], "id string, parent string")
    seen, complete = H.walked(claims, spark.createDataFrame([("r",)], "id string"), proof)
    assert complete and sorted((r.id, r.parent, r.depth) for r in seen.collect()) == [("a", "r", 1), ("b", "a", 2), ("c", "b", 3), ("r", None, 0)]


def test_capabilities(spark):
    def verdict(name, *how, **more):
        return spark.range(1).select(P.allowed(F.lit(name), *how, **more)).first()[0]

    assert verdict("anything") == "unknown" and verdict("knowledge_get") == "allowed" and verdict("knowledge_get", []) == "not_listed"
    assert verdict("knowledge_get", ["read"], ["knowledge_get"]) == "blocked" and verdict("knowledge_append", ["knowledge_append"], ["write"]) == "blocked"
    assert verdict("knowledge_append", read_only=True) == "read_only"


def test_confirmations_disabled(spark):
    rows = spark.createDataFrame([(1, "delete", "d", 1), (2, "append", "d", 2)], "id long, operation string, digest string, at long")
    assert [r.decision for r in P.confirmation(rows, rows.select("digest"), False).orderBy("id").collect()] == ["disabled", "allowed"]


def test_machines_step_by_step():
    s, out = states.lease(None, {"op": "acquire", "holder": 1, "now_ms": 0, "ttl_ms": 1})
    assert out == {"outcome": "acquired", "fence": 1} and s["until"] == 1000
    assert states.lease(s, {"op": "acquire", "holder": 2, "now_ms": 999, "ttl_ms": 1})[1]["outcome"] == "busy"
    assert states.lease(s, {"op": "renew", "holder": 1, "now_ms": 1000, "ttl_ms": 1})[1]["outcome"] == "lost"
    step = states.inbox(attempts=1)
    s, _ = step(None, {"op": "deliver", "now_ms": 0, "generation": 0})
    s, out = step(s, {"op": "claim", "now_ms": 0, "generation": 0})
    assert out["status"] == "running" and step(s, {"op": "complete", "now_ms": 1, "generation": 0})[1]["status"] == "running"
    s, out = step(s, {"op": "claim", "now_ms": 60_000, "generation": 0})
    assert out["status"] == "failed" and step(s, {"op": "requeue", "now_ms": 60_001, "generation": 1})[1] == {"status": "pending", "generation_now": 2, "attempt": 0}


def test_ids_and_targets(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]

    hosts = ["h.example"]
    kind = lambda t: one(lambda c: L.target_kind(c, hosts), t)
    page = "https://h.example/T-" + "a" * 32
    assert kind(page) == "page" and kind(page + "#b") == "block" and kind("#b") == "block" and kind("https://else.example/x") == "external" and kind("x y") == "invalid" and kind("a" * 32) == "page"
    assert one(lambda c: L.page_id(c, hosts), "https://h.example:443/" + "a" * 32) is None and one(L.uuid, "A" * 31) is None


def test_batches_are_frozen_while_they_are_claimed():
    step = states.page_batches(quiet_ms=100, most_ms=250, lease_ms=1000, attempts=2)
    state, said = None, []

    def do(op, now, event_id=0, generation=0):
        nonlocal state
        state, out = step(state, {"op": op, "now_ms": now, "event_id": event_id, "generation": generation})
        said.append(out)
        return out["outcome"]

    assert do("claim", 0) == "none" and do("hint", 0, 1) == "opened" and do("hint", 90, 2) == "joined" and do("claim", 100) == "early"
    assert do("hint", 180, 3) == "joined" and do("hint", 240, 4) == "joined" and do("claim", 249) == "early"
    assert do("claim", 250) == "claimed" and said[-1] == {"outcome": "claimed", "generation_now": 1, "size": 4, "newest": 4, "failed": 0}
    # what comes now opens a successor, and nobody else gets the page
    assert do("hint", 300, 5) == "opened" and do("claim", 500) == "busy" and do("complete", 600, generation=2) == "lost"
    assert do("retry", 700, generation=1) == "returned" and said[-1]["size"] == 5
    assert do("claim", 700) == "claimed" and said[-1]["size"] == 5 and said[-1]["newest"] == 5
    # the lease runs out: four members have had both their claims, the fifth has one left
    assert do("complete", 1700, generation=2) == "lost" and do("claim", 1700) == "claimed" and said[-1]["size"] == 1 and said[-1]["failed"] == 4
    assert do("complete", 1800, generation=3) == "completed" and said[-1]["size"] == 1 and do("claim", 9999) == "none"


def test_what_is_rejected_takes_no_room():
    step, state, said = states.admission(4), None, []
    for now, weight, hold in [(0, 3, 100), (10, 2, 1000), (20, 1, 50), (69, 1, 10), (70, 1, 10), (100, 4, 1), (100, 3, 10), (200, 5, 1)]:
        state, out = step(state, {"now_ms": now, "weight": weight, "hold_ms": hold})
        said.append((out["admitted"], out["active"]))
    assert said == [(True, 3), (False, 3), (True, 4), (False, 4), (True, 4), (True, 4), (False, 4), (False, 0)]
    assert (out["peak"], out["rejected"]) == (4, 4)


@pytest.mark.parametrize("name", ["ancestor_chain", "scope_authorized", "target_placement", "reachable_tree"])
def test_trees_are_not_bounded_by_the_rows_of_a_recursion(spark, name):
    from quern.plans.registry import queries

    held = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        assert queries()[name](spark, "/root/testdata/sf0.001").count() > 50
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", held)


def test_descended_takes_the_least_depth_and_stops(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("b", "r"), ("c", "b"), (None, "a"), ("d", "c"), ("r", "d")], "id string, parent string")
    got = lambda most: sorted(((r.id or "", r.parent or "", r.depth) for r in H.descended(nodes, nodes.filter("id = 'r' AND parent IS NULL"), most).collect()))
    assert got(64) == [("", "a", 2), ("a", "r", 1), ("b", "a", 2), ("b", "r", 1), ("c", "b", 2), ("d", "c", 3), ("r", "", 0), ("r", "d", 4)]
    assert got(1) == [("a", "r", 1), ("b", "r", 1), ("r", "", 0)]


def test_phrases_are_counted_in_one_pass(spark):
    chunks = spark.createDataFrame([(1, 1, "Red fish", "one red FISH, red-fish"), (2, 1, "", "redfish"), (3, 1, None, None)], "chunk_id long, page_id long, title string, text string").repartition(2)
    made = X.phrase_hits(chunks, ["red fish", "one"])
    assert sorted((r.chunk_id, r.score, r.evidence.ordinal, r.evidence.field) for r in made.collect()) == [(1, 1.5, 1, "text"), (1, 1.666667, 0, "text"), (1, 2.5, 0, "title")]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Repartition ") == 1
