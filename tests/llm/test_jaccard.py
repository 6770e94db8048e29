import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import jaccard as J
from quern.llm.graph import components


def shingles(text, n=3):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        key = J.NO_ID if doc is None else doc
        least[find(k)] = min(least.get(find(k), J.NO_ID), key)
    shown = lambda v: None if v == J.NO_ID else v
    return sorted((str(doc), len(sets[k]), str(shown(least[find(k)]) if sets[k] else doc)) for k, (doc, _) in enumerate(rows))


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        k = rng.randrange(len(words))
        if rng.random() < 0.3 and len(words) > 1:
            del words[k]
        else:
            words[k] = f"x{rng.randrange(10**6)}"
    return words


def corpus(seed, groups=12, copies=25):
    rng = random.Random(seed)
    rows = []
    shared = [f"s{k}" for k in range(60)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 40, 90, 200]))]
        if g % 3 == 0:
            base = shared + base
        family = [base]
        for _ in range(copies):
            family.append(edited(rng, rng.choice(family), rng.choice([0, 1, 1, 2, 5])))
        rows += family
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("seed,percent", [(1, 90), (2, 80)])
def test_components_by_brute_force(spark, seed, percent):
    rows = corpus(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "one two three"), (9007, "One two THREE"), (None, "one"), (None, None), (9003, "lone one here")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, node string").repartition(6)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.classes(df, J.Rule(percent=percent)).collect())
    assert got == brute(rows, percent)


def test_one_of_each_and_nothing(spark):
    df = spark.createDataFrame([(3, "a b c d"), (1, "A b c d"), (2, "z"), (None, "a b c d"), (4, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in J.one_of_each(df).collect()) == ["1", "2", "4", "None"]
    assert J.classes(df.limit(0)).count() == 0 and J.one_of_each(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")
    assert [tuple(r) for r in J.classes(lone).collect()] == [(7, 2, 7)]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 80), st.integers(0, 80), st.integers(0, 10**6), st.sampled_from([50, 75, 80, 90, 95, 100]))
def test_linked_sets_keep_a_common_cell(size, less, more, seed, percent):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    y = np.unique(np.concatenate([x[rng.permutation(len(x))[: max(1, len(x) - less)]], rng.integers(0, 2**63, more, dtype=np.uint64)]))
    shared = len(np.intersect1d(x, y))
    rule = J.Rule(percent=percent)
    if rule.linked(shared, len(x) + len(y) - shared):
        counts = {int(c): int(rng.integers(1, 5)) for c in np.union1d(x, y)}
        kept = [set(sorted(J.signatures(s, rule).tolist(), key=lambda c: (-counts[c], c))[J.spare(len(s), rule) :]) for s in (x, y)]
        assert kept[0] & kept[1]


def test_rows_without_ids_stay_in_proportion(spark):
    rows = [(None, f"w{k} x{k} y{k} z{k}") for k in range(60)] + [(None, "same words are here")] * 60
    got = J.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 120 and got.filter("component_id IS NULL").count() == 120


def test_rings_blocks_and_long_texts(spark, monkeypatch):
    """Small leaves and blocks, so that a few hundred texts go through every round; and a text of 200,000 words."""
    from quern.llm import regions

    monkeypatch.setattr(regions, "LEAF", 20)
    monkeypatch.setattr(regions, "BLOCK", 3)
    monkeypatch.setattr(regions, "SPREAD", 5)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows, chain = [], list(base)
    for k in range(90):  # a chain of small steps: its ends share little, and no pivot reaches all
        chain = edited(rng, chain, 1)
        rows.append((k, " ".join(chain)))
    rows += [(1000 + k, " ".join(base[:30] + [f"u{k}x{j}" for j in range(30)])) for k in range(30)]
    long = " ".join(f"l{k % 7919}" for k in range(200_000))
    rows += [(2000, long), (2001, long + " end"), (2002, long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.classes(df, J.Rule(percent=80)).collect())
    assert got == brute(rows, 80)


def test_sets_are_the_contracts():
    texts = ["a b c", "A  B\nC d", "", None, "x y", "x\x1cy z w", "a b c a b c a b c"]
    assert [len(s) for s in J.shingle_sets(pa.array(texts), 3)] == [len(shingles(t)) for t in texts]


def test_components_of_paths_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(500, 500), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_rings_are_joined_whatever_the_rounds(spark, monkeypatch):
    """With the rounds of pivots used up, rings over the leaf size are joined by blocks and lose no link."""
    from quern.llm import regions

    monkeypatch.setattr(regions, "LEAF", 3)
    rng = random.Random(8)
    sets = []
    for k in range(20):
        base = rng.sample(range(1000 * k, 1000 * k + 500), 40)
        sets += [base, [*base[:39], 10**6 + k], [*base[1:], 2 * 10**6 + k]]
    held = spark.createDataFrame([(i, " ".join(map(str, s))) for i, s in enumerate(sets)], "node long, payload string")
    members = held.selectExpr("1L cell", "node")
    sets_of = lambda column: [np.array(sorted(map(int, x.split())), np.uint64) for x in column.to_pylist()]
    rule = J.Rule(words=1, percent=90)
    want = {(i, j) for j in range(60) for i in range(j) if 100 * len({*sets[i]} & {*sets[j]}) >= 90 * len({*sets[i]} | {*sets[j]})}
    assert len(want) >= 40
    for most in (0, 1, regions.MOST_ROUNDS):
        links = regions.connected(members, held, sets_of, rule, most)
        assert {tuple(sorted((r.a, r.b))) for r in links.collect()} <= want
        root = {r.node: r.root for r in components(links).collect()}
        assert all(root[i] == root[j] for i, j in want) and len(set(root.values())) == 20, most
    with pytest.raises(ValueError):
        regions.connected(members, held, sets_of, rule, 61)


def test_stars_need_no_round_and_middling_rings_one(spark, monkeypatch):
    """Each round takes some ten shuffles, however few rows it has."""
    from quern.llm import graph, regions

    names, saved = [], graph.saved
    for module in (graph, regions):
        monkeypatch.setattr(module, "saved", lambda df, name: names.append(name) or saved(df, name))
    stars = spark.createDataFrame([(9, 1), (8, 1), (7, 2), (1, 9)], "a long, b long")
    assert {r.node: r.root for r in components(stars).collect()} == {9: 1, 8: 1, 1: 1, 7: 2, 2: 2}
    assert names.count("links") == 1
    sets = [np.arange(3 * k, 3 * k + 3, dtype=np.uint64) for k in range(700)]
    sets += [sets[5], sets[650]]
    held = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sets)], "node long, payload binary")
    links = regions.connected(held.selectExpr("1L cell", "node"), held, regions.stored_sets, J.Rule(words=1, percent=90))
    assert {tuple(sorted((r.a, r.b))) for r in links.collect()} == {(5, 700), (650, 701)}
    assert names.count("compared") == 1
