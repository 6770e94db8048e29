import random
from collections import Counter

import pytest

from quern.llm import rollups as R
from quern.llm.shared import shared_dir, tokenizer_file

SCHEMA = "doc_id long, tokenizer string, op string, source string, lang string, tokens long, seq int, docs long"


def test_batches_against_a_dictionary(spark):
    rng = random.Random(5)
    totals, held = R.Rollup(spark, shared_dir(spark, "t")), {}
    batches = {}
    for name in ("a", "b", "c", "d"):
        rows = []
        for seq in range(60):
            rows.append((rng.choice([None, *range(20)]), rng.choice(["t@1", "t@2"]), rng.choice([R.INSERT, R.INSERT, R.DELETE, R.REVISE]), rng.choice(["s", "u", None]), rng.choice(["en", None]), rng.randrange(50), seq, 99))
        batches[name] = rows
        last = {}
        for r in rows:
            last[r[0], r[1]] = r
        for key, r in last.items():
            if r[2] == R.DELETE:
                held.pop(key, None)
            elif r[2] == R.INSERT or key in held:
                held[key] = (r[3], r[4], r[5])
        assert totals.commit(name, spark.createDataFrame(rows, SCHEMA))
        want_docs, want = Counter(), Counter()
        for (_, t), (s, la, n) in held.items():
            want_docs[s, la, t] += 1
            want[s, la, t] += n
        got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in totals.totals().collect()}
        assert got == {k: (want_docs[k], want[k]) for k in want_docs}
    for name, rows in batches.items():
        assert not totals.commit(name, spark.createDataFrame(rows, SCHEMA))
    again = R.Rollup(spark, totals.folder)
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in again.totals().collect()} == got


def test_a_failed_batch_leaves_nothing(spark):
    totals = R.Rollup(spark, shared_dir(spark, "t"))
    rows = spark.createDataFrame([(1, "t", R.INSERT, "s", "en", 3, 0, 0)], SCHEMA)
    publish, totals._publish = totals._publish, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        totals.commit("x", rows)
    assert totals.totals().count() == 0
    totals._publish = publish
    assert totals.commit("x", rows) and [tuple(r) for r in totals.totals().collect()] == [("s", "en", "t", 1, 3)]
    assert totals.commit("none", rows.limit(0)) and totals.totals().count() == 1


def test_public_tokenizer_counts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    rows = [(1, "s", "en", "hello there <|endoftext|>"), (2, None, None, None), (3, "s", "de", "")]
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    got = {r.doc_id: r.tokens for r in R.bpe_counts(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, _, _, t in rows}
