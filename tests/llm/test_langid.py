import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import langid as L
from quern.llm.shared import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001/documents.parquet"


def all_segmentations(text, pieces, column):
    if not text:
        return 1.0
    total = 0.0
    for j in range(1, min(len(text), L.PIECE_CHARS) + 1):
        piece = pieces.get(text[:j], len(pieces) if j == 1 else None)
        if piece is not None:
            total += column[piece] * all_segmentations(text[j:], pieces, column)
    return total


def test_forward_sums_all_segmentations():
    pieces = L.vocabulary(PATH)
    rng = np.random.default_rng(5)
    chances = rng.random((len(pieces) + 1, 2))
    chances /= chances.sum(axis=0)
    words = ["the", "straße", "a", "ж漢", "interne"]
    got = L.word_scores(words, L.piece_tables(PATH), chances)
    for k, w in enumerate(words):
        for c in range(2):
            assert math.isclose(got[k, c], math.log(all_segmentations("▁" + w, pieces, chances[:, c])), rel_tol=1e-9)


def test_expected_uses_by_brute_force():
    pieces = L.vocabulary(PATH)
    rng = np.random.default_rng(6)
    chances = rng.random((len(pieces) + 1, 2))
    chances /= chances.sum(axis=0)

    def walks(text, column):
        if not text:
            yield [], 1.0
        for j in range(1, len(text) + 1):
            piece = pieces.get(text[:j], len(pieces) if j == 1 else None)
            if piece is not None:
                for rest, p in walks(text[j:], column):
                    yield [piece, *rest], p * column[piece]

    words, weight, language = ["then", "ein"], np.array([2.0, 3.0]), np.array([0, 1])
    want = np.zeros_like(chances)
    for w, n, c in zip(words, weight, language, strict=True):
        every = list(walks("▁" + w, chances[:, c]))
        whole = sum(p for _, p in every)
        for path, p in every:
            for piece in path:
                want[piece, c] += n * p / whole
    assert np.allclose(L.expected(words, weight, language, L.piece_tables(PATH), chances), want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = L.identify(docs, PATH).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und" and len(r.text) > 100]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) > 20


def test_odd_rows_and_no_use_of_labels(spark):
    rng = random.Random(1)
    word = {"xx": ["alpha", "gamma", "delta"], "yy": ["omikron", "sigma", "psi"]}
    rows = [(k, " ".join(rng.choices(word[lang], k=20)), lang, "s") for k in range(40) for lang in ("xx", "yy")]
    odd = [(100, None, "xx", "t"), (101, "", None, None), (102, "12 ½ _ !", "yy", None), (None, "alpha gamma", None, None), (None, "alpha gamma", None, None), (103, "z" * 5000, None, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = L.identify(df, PATH).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and by[101].score == 0
    assert by[None].lang_pred == "xx" and by[103].lang_pred in ("xx", "yy") and 0 <= by[103].score <= 1
    relabelled = df.withColumn("lang", F.when(L.fold() == L.HELD_OUT, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(str, L.identify(relabelled, PATH).collect())) == sorted(map(str, got))
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", F.lit(None).cast("string")), PATH).collect()} == {"und"}
    assert L.identify(df.limit(0), PATH).count() == 0
    assert L.accepted(df, PATH).columns == df.columns


def test_texts_go_to_python_once_and_tables_fit_them(spark):
    """What each worker holds: one copy of a batch's text, and tables of powers no larger than its words need."""
    from quern.llm import shared

    df = spark.createDataFrame([(1, "hello world", "en"), (2, None, None)], "doc_id long, text string, lang string")
    plan = L.accepted(df, PATH)._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan and "AS key" not in plan
    held = dict(shared._powers)
    shared._powers.clear()
    up, down = shared.powers(1000)
    assert 1000 <= len(up) == len(down) <= 1 << 16
    assert (up * down == 1).all()
    shared._powers.update(held)
