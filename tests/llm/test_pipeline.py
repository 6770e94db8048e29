import random

import corpus_pipeline
from quern.llm import queries
from quern.llm.shared import word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(3)
    word = {"xx": [f"alpha{c}" for c in "abcdefghij"], "yy": [f"omik{c}" for c in "klmnopqrst"]}
    rows = []
    for k in range(60):
        lang = "xx" if k % 2 else "yy"
        text = " ".join(rng.choice(word[lang]) + rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(90))
        rows.append((k, text, lang, f"s{k % 4}", len(text)))
    passage = " ".join(f"passag{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    for k in (5, 9):
        text = rows[k][1] + " " + passage + " end"
        rows[k] = (k, text, *rows[k][2:4], len(text))
    rows += [(100, rows[7][1], "xx", "s1", 1), (101, rows[8][1] + " zusatz", "yy", "s0", 1), (102, None, None, None, None), (103, "12 34 !!", None, "s1", 8)]
    return rows, passage


def test_stages_one_after_another(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    steps = dict(corpus_pipeline.STAGES)
    known = steps["language_id"](spark, docs, "")
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert known.columns == docs.columns and ids(docs) - ids(known) == {102, 103}
    apart = steps["jaccard_join"](spark, known, "")
    assert ids(known) - ids(apart) == {100, 101}
    kept = steps["paragraph_dedup"](spark, apart, "")
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert passage in texts[5] and passage not in texts[9] and texts.keys() == ids(apart)
    assert all(texts[r[0]] == r[1] for r in rows if r[0] in texts and r[0] != 9)
    mixed = steps["source_mixture"](spark, kept, "")
    assert mixed.columns == docs.columns and ids(mixed) <= ids(kept)
    total = lambda df: df.select(word_count(df["text"]).alias("n")).groupBy().sum().first()[0]
    assert abs(total(mixed) - total(kept)) <= 4 * 128
    coded = steps["piece_codec"](spark, mixed, "")
    assert coded.count() == mixed.count() and coded.filter("n_tokens <= 2").count() == 0


def test_registered():
    names = set(queries.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
