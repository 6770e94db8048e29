import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quern.llm import ngram as N
from quern.llm.shared import mix


def tokens(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Plain:
    """The same model by dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            said = tokens(t)
            self.words.update(said)
            self.pairs.update(zip(["<start>", *said[:-1]], said, strict=True))
        self.context = Counter(self.words) + Counter({"<start>": len(texts)})
        self.before = Counter(w for _, w in self.pairs)
        self.d = N.discounts([sum(c == k for c in self.pairs.values()) for k in (1, 2, 3, 4)])
        self.e = N.discounts([sum(c == k for c in self.before.values()) for k in (1, 2, 3, 4)])
        self.after = defaultdict(list)
        for (v, _), c in self.pairs.items():
            self.after[v].append(c)

    def low(self, w):
        t, size = len(self.pairs), len(self.words) + 1
        left = sum(self.e[min(c, 3) - 1] for c in self.before.values()) / t if t else 1
        c = self.before.get(w, 0)
        return (c - self.e[min(c, 3) - 1] if c else 0) / max(t, 1) + left / size

    def p(self, v, w):
        total = self.context.get(v, 0)
        if not total:
            return self.low(w)
        c = self.pairs.get((v, w), 0)
        left = sum(self.d[min(x, 3) - 1] for x in self.after[v]) / total
        return (c - self.d[min(c, 3) - 1] if c else 0) / total + left * self.low(w)

    def score(self, text):
        said = tokens(text)
        return sum(math.log10(self.p(v, w)) for v, w in zip(["<start>", *said[:-1]], said, strict=True))


def corpus(n=200):
    rng = random.Random(8)
    vocabulary = [f"w{k}" if k % 3 else f"W{k}é" for k in range(60)]
    return [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 30))) if k % 17 else None for k in range(n)]


def test_against_plain_python(spark):
    texts = corpus()
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(500, "never\tseen  w1\nw2", "y"), (500, "never\tseen  w1\nw2", "y"), (None, "w1", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, count string").repartition(5)
    got = N.score_documents(df).collect()
    assert len(got) == len(rows)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    train = [t for i, t, _ in rows if fold(i) != 0]
    plain = Plain(train)
    total, size = sum(plain.words.values()), len(plain.words)
    text = {i: t for i, t, _ in rows}
    for r in got:
        said = tokens(text[r.doc_id])
        assert r.held_out == (fold(r.doc_id) == 0) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(said), sum(plain.words[w] > 0 for w in said))
        assert math.isclose(r.base_score, sum(math.log10((plain.words[w] + 0.1) / (total + 0.1 * (size + 1))) for w in said), rel_tol=1e-9)
        assert math.isclose(r.score, plain.score(text[r.doc_id]), rel_tol=1e-9)


def test_chances_sum_to_one():
    plain = Plain(corpus())
    for v in ("w1", "<start>", "w8", "unseen"):
        assert math.isclose(sum(plain.p(v, w) for w in plain.words) + plain.p(v, "unseen"), 1, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(k, "a b") for k in range(60) if zlib.crc32(str(k).encode()) % 10 == 0], "doc_id long, text string")
    assert all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in N.score_documents(df).collect())
    assert N.score_documents(df.limit(0)).count() == 0


def test_hash_inverse_and_tokens():
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0xDEADBEEF1234567)
    assert (N.unmix(mix(x)) == x).all()
    texts = ["A  b", None, "", "x\x0by z Q", "a b"]
    got, first = N.tokens_of(pa.array(texts))
    assert np.diff(first).tolist() == [len(tokens(t)) for t in texts]
    flat = [w for t in texts for w in tokens(t)]
    same = defaultdict(set)
    for w, h in zip(flat, got.tolist(), strict=True):
        same[w].add(h)
    assert all(len(v) == 1 for v in same.values()) and len({h for v in same.values() for h in v}) == len(same)
