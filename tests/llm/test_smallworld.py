import numpy as np

from quern.llm import smallworld as S


def brute(rows):
    x = {}
    valid = []
    for k, (_, v) in enumerate(rows):
        ok = v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        if ok:
            valid.append(k)
    widths = [len(rows[k][1]) for k in valid]
    width = max(sorted(set(widths)), key=widths.count) if widths else 0
    valid = [k for k in valid if len(rows[k][1]) == width]
    m = np.array([rows[k][1] for k in valid], np.float64).reshape(len(valid), width)
    m = m / np.abs(m).max(axis=1, keepdims=True) if len(m) else m
    m = m / np.sqrt((m * m).sum(axis=1, keepdims=True)) if len(m) else m
    near = m @ m.T >= S.LEAST
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(near), strict=True):
        root[find(valid[a])] = find(valid[b])
    for k in range(len(rows)):
        x[k] = int(near[valid.index(k)].sum()) - 1 if k in valid else 0
    key = [S.NO_ID if i is None else i for i, _ in rows]
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), S.NO_ID), key[k])
    shown = lambda v: None if v == S.NO_ID else v
    return sorted((str(rows[k][0]), x[k], str(shown(least[find(k)]))) for k in range(len(rows)))


def corpus(n=400, d=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.normal(size=d)
        for _ in range(rng.integers(1, 12)):
            rows.append((base + rng.normal(size=d) * rng.choice([0, 0.05, 0.2])).astype(np.float32).tolist())
    return [(k, v) for k, v in enumerate(rows)]


def test_against_all_pairs(spark):
    rows = corpus()
    rows += [(k, rows[0][1]) for k in range(5000, 5060)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] + [1.0] * 15), (9005, [None] + [1.0] * 15), (9006, [1.0]), (None, rows[0][1]), (None, None), (3, [-x for x in rows[3][1]])]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows + odd], "vec_id long, embedding array<float>, node int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in S.near_duplicates(df).collect())
    assert got == brute(rows + odd)
    assert all(r.kept == (r.vec_id == r.component_id) for r in S.near_duplicates(df).collect() if r.vec_id is not None)


def test_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r)[:4] for r in S.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_one_graph(tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 32))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.08 for _ in range(6)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = S.Builder(x, np.arange(len(x)))
    for name, v in (("nodes", np.arange(len(x))), ("units", x), ("weight", np.ones(len(x), np.int64)), ("near", np.concatenate([a.ravel() for a in made.near])), ("head", np.array([len(x), made.entry, len(made.near)]))):
        S.put(str(tmp_path), f"0.{name}", v)
    qi, ni = S.Shard(str(tmp_path), 0, 32).search(x, 32)
    want = set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= S.LEAST)), strict=True))
    got = set(zip(qi.tolist(), ni.tolist(), strict=True))
    assert got <= want and len(got) >= 0.97 * len(want) and len(got) == len(qi)


def test_every_length_is_searched_and_recall_is_told(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(600)]
    short = rng.normal(size=(20, 8))
    rows += [(1000 + 2 * k + j, (v + j * 1e-3).tolist()) for k, v in enumerate(short) for j in range(2)]
    got = {r.vec_id: r for r in S.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[1001 + 2 * k].component_id == 1000 + 2 * k for k in range(20))
    # nothing to audit by: all is compared exactly
    assert all(r.recall == 1.0 and r.beam == 0 for r in got.values())


def test_audit_counts_nodes_and_gives_way_to_exact_search(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base + 1e-3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # one pair holds nearly all rows
    made = [(k, v.tolist(), 10**6 if k % 300 == 0 else 1) for k, v in enumerate(x)]
    nodes = spark.createDataFrame(made, "node long, unit array<double>, weight long")
    folder = S.shared_dir(spark, "audit")
    S.build(nodes, 16, folder, 2)
    beam, recall = S.audit(nodes, 600, 16, folder, 2)
    assert beam and S.GOAL <= recall <= 1
    assert S.audit(nodes, 600, 16, folder, 2, goal=2.0) == (0, 1.0)
    assert S.query(nodes, 16, folder, 2, 0).agg({"others": "sum"}).first()[0] == int((x @ x.T >= S.LEAST).sum()) - 600
