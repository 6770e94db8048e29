import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def counts(kind, said):
    digits = re.sub("[^0-9]", "", said)
    if kind == "ip":
        return all(int(x) <= 255 for x in said.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if counts(kind, m[0])]


def check(rows, got):
    for doc_id, text in rows:
        want = base(text)
        r = got[doc_id]
        said = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest(), (text, said, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(said) <= set(spans) and len(spans) == len(said) + r.n_added
        key = [(list(PATTERNS).index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert key == sorted(key)


PIECES = ["a@b.co", "x@", "@y.z", "a@b", "1.2.3.4", "256.1.1.1", "000.01.2.255", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "4111111111111112", "0 0", "+1 (609) 555-7932", "+49 12", "+1+2 3456789", " ", "\n", "é", "😀", ".", "-", "_", "9", "word", "0" * 19]


def test_strict_spans_as_by_definition(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    rows += [(2000, None), (2001, "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, strict string, email int")
    check(rows, {r.doc_id: r for r in pii.span_digest(df).collect()})
    assert pii.span_digest(df.limit(0)).count() == 0


def test_very_long_texts_and_repeated_rows(spark):
    """Runs that a careless pattern takes quadratic time over, and ten thousand matches in a text."""
    shapes = [lambda n: "a" * n + " @", lambda n: "9" * n, lambda n: "1." * (n // 20), lambda n: "+1 " * n, lambda n: "a@b." * (n // 50), lambda n: "(" * n + "1 2-" * (n // 9)]
    # the plain patterns take quadratic time on the long ones, so those are held against the short ones' results
    rows = [(i, shape(2_000)) for i, shape in enumerate(shapes)]
    long = [(10 + i, shape(1_000_000)) for i, shape in enumerate(shapes)]
    df = spark.createDataFrame([*rows, *long, (30, "q@r.st 10.0.0.1 " * 10_000), (None, "m@n.op"), (6, "m@n.op"), (6, "m@n.op")], "doc_id long, text string")
    got = pii.span_digest(df).collect()
    assert len(got) == 16 and sum(r.spans == "email:0:6" for r in got) == 3
    by = {r.doc_id: r for r in got}
    check(rows, by)
    assert by[10].spans == by[11].spans == by[13].spans == by[15].spans == ""
    assert by[12].n_ip == 50_000 // 4 and by[14].n_email == 10_000
    (many,) = [r for r in got if r.n_ip == 10_000]
    assert many.n_email == 10_000 and many.spans.endswith(f"ip:{16 * 9999 + 7}:{16 * 9999 + 15}")


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    said = {
        "email": lambda: f"{word()}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com",
        "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "phone": lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
    }
    rows = []
    for i in range(3000):
        text = [word() for _ in range(12)]
        if i % 3 == 0:
            text[6] = said[["email", "ip", "phone"][i // 3 % 3]]()
        elif i % 30 == 1:
            text[6] = "token = \"" + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + "\""
        elif i % 30 == 2:
            text[6] = str(rng.randint(10**15, 10**16 - 1))
        rows.append((i, " ".join(text)))
    return rows


def test_trees_add_what_the_patterns_miss_and_leave_clean_texts(spark):
    rows = corpus()
    odd = {
        5000: ("w +1 (609) 555-7932 190.137.223.204 w", "phone:2:19"),
        5001: ("w anna.17 [at] mail3.example [dot] com w", "email:2:38"),
        5002: ("w build 12 of 2024-01-02 03:04 w", ""),
        5004: ("w anna at mail dot com w", "email:2:22"),
        5003: ("w look at her dot and sit w at 9 o'clock", ""),
    }
    df = spark.createDataFrame(rows + [(k, t) for k, (t, _) in odd.items()], "doc_id long, text string")
    made = {r.doc_id: r for r in pii.span_digest(df).collect()}
    for k, (_, span) in odd.items():
        assert (span in made[k].spans.split(",")) if span else made[k].spans == "", made[k]
    clean = [k for k, t in rows if not base(t)]
    assert sum(made[k].n_added > 0 for k in clean) == 0
    again = {r.doc_id: r for r in pii.span_digest(df.repartition(7)).collect()}
    assert made == again


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    for made in (pii.candidates(df, pii.Rule()), pii.detect(df)):
        plan = made._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "InPandas", "ExternalRDD"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 1), st.integers(1, 50)), min_size=1, max_size=30))
def test_trees_and_their_expression_agree(rows):
    x = np.zeros((len(rows), len(pii.FEATURES)), np.int64)
    x[:, 0], x[:, 1] = [r[0] for r in rows], [r[1] for r in rows]
    y, n = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    trees = pii.fit(x, y, n, pii.Rule(rounds=8))
    score = pii.scored(trees, x)

    def plain(t, row):
        if not isinstance(t, tuple):
            return t
        return t[0] if len(t) == 1 else plain(t[2] if row[t[0]] <= t[1] else t[3], row)

    assert np.allclose(score, [sum(plain(t, row) for t in trees) for row in x])
    loss = lambda s: -(n * (y * s - np.log1p(np.exp(s)))).sum()
    assert loss(score) <= loss(np.zeros(len(rows))) + 1e-9


def test_expression_in_spark(spark):
    x = np.array([[a, b, *[0] * (len(pii.FEATURES) - 2)] for a in range(4) for b in range(2)])
    trees = pii.fit(x, (x[:, 0] > 1).astype(int) | x[:, 1], np.full(8, 9.0), pii.Rule())
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{f} int" for f in pii.FEATURES))
    got = df.select(pii.expression(trees, F.struct(*pii.FEATURES)).alias("s")).collect()
    assert np.allclose([r.s for r in got], pii.scored(trees, x))
    assert ((pii.scored(trees, x) > 0) == ((x[:, 0] > 1) | (x[:, 1] == 1))).all()


def test_threshold_keeps_precision():
    score, y, n = np.array([3.0, 2.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 1, 0]), np.array([10, 5, 1, 2, 50])
    assert pii.threshold(score, y, n, 0.9) == 1.0
    assert pii.threshold(score, y, n, 0.99) == 3.0
    assert pii.threshold(np.array([2.0, -1.0]), np.array([1, 0]), np.array([99, 1]), 0.9) == 2.0
    assert pii.threshold(np.zeros(0), np.zeros(0), np.zeros(0), 0.9) is None
