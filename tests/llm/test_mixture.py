import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm import mixture as M
from quern.llm.shared import running_sum

HOW = M.Mix(block_words=4, shard_slots=8)


def rows(n=120):
    out = []
    for k in range(n):
        source = None if k % 11 == 0 else "hot" if k % 3 == 0 else f"s{k % 7}"
        out.append((k, source, " ".join(f"W{k}.{i}" for i in range(k * 7 % 23)) if k % 13 else None, "clash"))
    return [*out, (505, "s5", "a b", "x"), (505, "s5", "a b", "x"), (None, "s1", "q  r\ns", "y"), (None, "s1", "q  r\ns", "y")]


def want_targets(rows, most=3):
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        level = left / (sum(w for s, w in weight.items() if s not in capped) or 1)
        more = {s for s in sizes if s not in capped and level * weight[s] > most * sizes[s]}
        if not more:
            return sizes, {s: most * sizes[s] if s in capped else level * weight[s] for s in sizes}
        capped |= more


def test_targets_and_taken(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, source string, text string, sid string")
    sizes, target = want_targets(data)
    got = M.taken(df, HOW).collect()
    assert len(got) == len(data)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, _, t, _ in data)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = defaultdict(int)
    for r in got:
        by[round(r.target, 6), r.source_size] += r.taken
    for s in sizes:
        assert abs(by[round(target[s], 6), sizes[s]] - target[s]) <= 3 * HOW.block_words or len([x for x in sizes if (target[x], sizes[x]) == (target[s], sizes[s])]) > 1
    again = M.taken(df.repartition(7, F.rand(3)), HOW).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents_hold_what_is_taken(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, source string, text string, sid string")
    taken = Counter()
    for r in M.taken(df, HOW).collect():
        taken[r.doc_id] += r.taken
    held, text = Counter(), {i: t for i, _, t, _ in data}
    for r in M.mixed_documents(df.drop("sid").withColumn("n_chars", F.lit(0).cast("long")), HOW).collect():
        words = r.text.split()
        held[r.doc_id] += len(words)
        assert not Counter(words) - Counter(text[r.doc_id].split()) and r.n_chars == len(r.text)
    assert held == +taken


def test_texts_are_shuffled_once_and_not_stored(spark, monkeypatch):
    stored, saved = [], M.saved
    monkeypatch.setattr(M, "saved", lambda df, name: stored.extend(df.columns) or saved(df, name))
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string, sid string").drop("sid")
    plan = M.mixed_documents(df, HOW)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "text" not in stored
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\n]*\btext#", plan)) == 1, plan


def test_texts_that_tie_keep_their_own_words(spark):
    data = [(i, "s", t, k) for k, (i, t) in enumerate([(7, "a b c"), (7, "d e f"), (None, "g h i"), (None, "g h i"), (None, "j k l"), (0, "m n o")])]
    df = spark.createDataFrame(data, "doc_id long, source string, text string, n int")
    got = M.mixed_documents(df, HOW).collect()
    assert {(r.doc_id, *r.text.split()) for r in got} == {(i, *t.split()) for i, _, t, _ in data}
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in M.taken(df, HOW).collect())
    again = M.mixed_documents(df.orderBy(F.desc("n")), HOW).collect()
    assert Counter((r.doc_id, r.text) for r in again) == Counter((r.doc_id, r.text) for r in got)


def test_nothing_and_one(spark):
    df = spark.createDataFrame([(1, None, "a b c d e")], "doc_id long, source string, text string")
    assert [(r.size, r.source_size, r.target, r.taken) for r in M.taken(df, HOW).collect()] == [(5, 5, 5.0, 5)]
    assert M.taken(df.limit(0), HOW).count() == 0 and M.mixed_documents(df.limit(0), HOW).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (1, "a", " "), (2, "b", "")], "doc_id long, source string, text string")
    assert [(r.size, r.taken) for r in M.taken(blank, HOW).collect()] == [(0, 0)] * 3


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        for key in (0, 5):
            x = M.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(x.tolist()) == list(range(n))


def test_shards_get_the_slots(spark):
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string, sid string")
    made = M.plan(df, HOW)
    slots = made.slots.groupBy("sid").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    want = {r.sid: r.slots for r in made.sources.collect()}
    assert {r.sid: r.n for r in slots} == {s: n for s, n in want.items() if n}
    assert all(r.n == r.d == r.m + 1 for r in slots)
    assert all(r.block < next(s.blocks for s in made.sources.collect() if s.sid == r.sid) for r in made.slots.take(20))


def test_running_sum_against_python(spark):
    data = [(g, k, (g * 7 + k * 3) % 5) for g in range(4) for k in range(60 if g == 2 else 5)]
    df = spark.createDataFrame(data, "g long, k long, v long").repartition(9)
    got = {(r.g, r.k): r.s for r in running_sum(df, "g", [F.col("k")], "v", "s").collect()}
    for g, k, _ in data:
        assert got[g, k] == sum(v for a, b, v in data if a == g and b < k)


def test_words_are_the_contracts(spark):
    texts = ["a\x0bb\x1cc d", " \t\n", "x\xa0y z"]
    from quern.llm.shared import word_count

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(word_count(F.col("text"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
