import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import periods
from quern.llm.queries import op13_periodic_runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, power=3):
    """All runs by their definition: every period, every maximal stretch, no smaller period."""
    n, out = len(words), []
    for q in range(1, n // power + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            a = i
            while i < n and words[i] == words[i - q]:
                i += 1
            s, length = a - q, i - a + q
            if length >= max(least, power * q) and not any(all(words[k] == words[k - e] for k in range(s + e, i)) for e in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def damaged(doc_id, text):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def digest(doc_id, words):
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=60), st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12), st.lists(st.integers(0, 3), max_size=9)).map(lambda x: x[0] * x[1] + x[2])), max_size=5), st.integers(1, 30), st.integers(3, 4))
def test_all_runs_of_any_words(texts, least, power):
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    start, length, period = periods.runs_of(np.array([w for t in texts for w in t], np.int64), bounds, periods.Rule(least, power))
    want = [(s + int(b), n, q) for b, t in zip(bounds, texts) for s, n, q in brute(t, least, power)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


def test_two_powers_are_refused():
    with pytest.raises(ValueError):
        periods.Rule(power=2)


def test_documents_as_by_definition(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \n", "a " * 5000, "é ü  " * 9 + "tail", "x\x0by\x1cz " * 30, "one"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += [" ".join((rng.sample("abcdefghijklmnop", rng.randint(1, 12)) * 9)[: rng.randint(1, 80)]) + "\n" + "q r s " * rng.randint(0, 12) for _ in range(80)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "u v " * 20, "x", 2), (3, "w " * 40, "x", 3), (3, "w " * 40, "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, words int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path)).drop("n_words").collect()
    # a long text of one word is checked by hand: quadratic by definition
    want = [digest(i, damaged(i, t)) for i, t, *_ in rows if t is None or len(t) < 9000]
    assert sorted((tuple(r) for r in got if r.doc_id != 3 or r.length != 5000), key=str) == sorted(want, key=str)
    (long,) = [r for r in got if r.length == 5000]
    assert (long.doc_id, long.n_runs, long.start, long.period, long.exponent_milli) == (3, 1, 0, 1, 5000000)
    assert long.collapsed_sha256 == hashlib.sha256(b"a").hexdigest()
    assert periods.run_digest(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """A text over the slice, periodic in its middle, beside one of a single frequent word."""
    loop = [f"w{i}" for i in range(3000)]
    words = [f"h{i % 977}x{i}" for i in range(300_000)] + loop * 5 + ["end"] + ["of"] * 200_000
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    r = periods.find_runs(df).first()
    assert [tuple(x) for x in r.runs] == [(300_000, 15_000, 3000), (315_001, 200_000, 1)]
    assert r.words == len(words) and r.collapsed.split(" ") == words[:303_000] + ["end", "of"]


def test_damage_as_the_contract_says(spark):
    rows = [(i, t) for i in range(400) for t in ("a b  c\td e f g h i j k l m n o p q r s t u v w x y z", "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", periods.looped(df["text"], df["doc_id"]).alias("now")).collect()
    assert all(WORDS.findall(r.now) == damaged(r.doc_id, r.text) for r in got)
    assert any(r.now != r.text for r in got)
