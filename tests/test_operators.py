import random

import pytest

from quern.operators import search as S
from quern.operators.debounce import debounce, fold


def fused(spark, semantic, lexical, **how):
    def hits(ids):
        rows = [(k, float(len(ids) - n)) for n, k in enumerate(ids)]
        return spark.createDataFrame(rows, "chunk_id string, score double")

    return [(r.chunk_id, r.score) for r in S.fuse(hits(semantic), hits(lexical), 10, S.Fusion(**how)).collect()]


def test_rank_fusion_numbers(spark):
    got = fused(spark, ["semantic", "shared"], ["lexical", "shared"])
    assert [k for k, _ in got] == ["shared", "lexical", "semantic"] and got[0][1] == pytest.approx(2 / 62, abs=1e-9)
    assert fused(spark, ["a", "z"], ["z", "a"])[0][0] == "z"
    assert fused(spark, ["a", "b", "z"], ["z", "b", "a"], lexical_weight=0.5)[0][0] == "a"
    assert fused(spark, ["a"], ["b"], k=0, semantic_weight=0.1)[0] == ("b", 1.0)


def test_graph_boost_numbers(spark):
    rows = [(1, 1, 1.0, 1, "semantic+lexical"), (3, 3, 0.9, 2, "semantic"), (2, 2, 0.85, None, "semantic"), (4, 4, 0.8, None, "semantic")]
    hits = spark.createDataFrame(rows, "chunk_id long, page_id long, score double, lexical_rank long, paths string")
    edges = spark.createDataFrame([(1, 2), (9, 4)], "source long, target long")
    got = {r.chunk_id: r.rank_score for r in S.graph_boost(hits, edges, 0.2, 1).collect()}
    assert got == {1: 1.0, 2: pytest.approx(0.9925), 3: 0.9, 4: 0.8}
    none = S.graph_boost(hits.filter("chunk_id > 1"), edges).collect()
    assert all(r.rank_score == r.score for r in none)


@pytest.mark.parametrize("limit,vector", [(0, [1.0]), (101, [1.0]), (5, []), (5, [float("nan")]), (5, [0.0, 0.0])])
def test_bad_requests_are_refused(spark, limit, vector):
    with pytest.raises(ValueError):
        S.nearest(spark.createDataFrame([], "chunk_id long, vector array<double>"), vector, limit)


def test_debounce_numbers():
    assert list(fold([(0, 1), (400, 2), (800, 3)], 1000, 10_000)) == [(0, 3, 0, 1800, 3)]
    assert list(fold([(0, 9), (-100, 5)], 1000, 10_000)) == [(0, 2, 0, 1000, 9)]
    capped = list(fold([(900 * k, k) for k in range(5)], 1000, 3000))
    assert capped[0] == (0, 4, 0, 3000, 3)


def test_debounce_of_a_table_is_the_fold(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3]), e, rng.randrange(50_000)) for e in range(300)] + [(None, 1, 1)]
    got = sorted(tuple(r) for r in debounce(spark.createDataFrame(rows, "page long, event_id long, ms long"), 700, 3000).collect())
    want = sorted((p, *b) for p in (1, 2, 3) for b in fold(sorted((ms, e) for q, e, ms in rows if q == p), 700, 3000))
    assert got == want
    assert debounce(spark.createDataFrame([], "page long, event_id long, ms long"), 1, 2).filter("page IS NOT NULL").count() == 0


def test_ivf_reaches_its_recall_over_all_queries(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(12)]) for k in range(1500)]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    asked = v.filter("chunk_id % 50 = 0")
    exact = {(r.query_id, r.chunk_id) for r in S.nearest_each(v, asked, 20).collect()}
    hits, recall = S.ivf(v, asked, 20)
    found = {(r.query_id, r.chunk_id) for r in hits.collect()}
    assert len(exact) == 30 * 20 and len(found & exact) / len(exact) == pytest.approx(recall) and recall >= 0.9
    one = S.nearest(v, rows[50][1], 20).collect()
    assert {(50, r.chunk_id) for r in one} == {x for x in exact if x[0] == 50}


def test_late_hints_join_without_moving_the_due_time(spark):
    rows = [(1, 1, 1000, 0), (1, 2, 900, 1), (1, 3, 1500, 2)]
    got = debounce(spark.createDataFrame(rows, "page long, event_id long, ms long, arrival long"), 700, 3000).collect()
    assert [tuple(r) for r in got] == [(1, 0, 3, 1000, 2200, 3)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_all_queries_by_blocks_are_each_query_alone(spark, metric):
    r = random.Random(3)
    rows = [(k, [float(r.randint(-3, 3)) for _ in range(4)]) for k in range(2500)]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(5)
    got = {}
    for h in S.nearest_each(v, v.filter("chunk_id % 500 = 0"), 7, metric).collect():
        got.setdefault(h.query_id, []).append((h.chunk_id, h.score))
    for k, x in rows[::500]:
        if metric == "l2" or any(x):
            want = [(h.chunk_id, h.score) for h in S.nearest(v, x, 7, metric).collect()]
            assert sorted(got[k]) == sorted(want)


def test_blocks_of_one_length_are_dealt_out(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(300)], "chunk_id long, vector array<double>")
    plan = S.nearest_each(v, v.filter("chunk_id % 50 = 0"), 5, "l2")._jdf.queryExecution().optimizedPlan().toString()
    assert "v_part" in next(line for line in plan.splitlines() if "Join" in line)
